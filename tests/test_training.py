import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import registry, training

CKPT = "run_id string, step long, path string, metric double"


def ckpts(spark, rows, run="r"):
    return spark.createDataFrame([(run, s, f"checkpoint-{s}", m) for s, m in rows], CKPT)


def test_latest_is_by_number(spark):
    assert training.latest_checkpoint(ckpts(spark, [(100, None), (200, None), (50, None)])).first()["step"] == 200


def test_keep_best(spark):
    df = ckpts(spark, [(100, 0.5), (200, 0.3), (300, 0.4), (400, None), (500, 0.3)])
    for width in (100, 10_000):
        steps = lambda d: [r["step"] for r in d.orderBy("rank").collect()]
        assert steps(training.keep_best_checkpoints(df, 2, block_width=width)) == [200, 500]
        assert steps(training.keep_best_checkpoints(df, 2, True, block_width=width)) == [100, 300]
        assert steps(training.keep_best_checkpoints(df, 9, block_width=width)) == [200, 500, 300, 100, 400]


def test_best(spark):
    df = ckpts(spark, [(100, 0.5), (200, 0.3), (300, 0.3), (400, None)])
    assert training.best_checkpoint(df).first()["step"] == 200
    assert training.best_checkpoint(df, True).first()["step"] == 100
    assert training.best_checkpoint(ckpts(spark, [(1, None), (7, None)])).first()["step"] == 7


def test_resume(spark):
    df = ckpts(spark, [(100, 0.5), (1000, 0.4), (200, 0.3), (500, 0.2)])
    fail = spark.createDataFrame([("r", 1000)], "run_id string, failed_step long")
    assert training.resume_checkpoint(df, fail).first()["resume_step"] == 500


def brute_stop(values, patience, threshold, greater):
    best, misses = None, 0
    for step, v in values:
        if best is None:
            best = v
        elif (v > best + threshold) if greater else (v < best - threshold):
            best, misses = v, 0
        else:
            misses += 1
            if misses >= patience:
                return step, best
    return None, best


@pytest.mark.parametrize("patience,threshold,greater", [(2, 0.0, False), (3, 1.0, False), (4, 0.0, True), (5, 2.0, True)])
def test_early_stopping(spark, patience, threshold, greater):
    draw = random.Random(patience)
    runs = {"down": [(i * 10, float(100 - i)) for i in range(60)], "flat": [(i, 1.0) for i in range(9)], "one": [(5, 2.0)],
            "slow": [(i, 100 - i * 0.9) for i in range(80)]}
    for n in range(12):
        level = 50.0
        runs[f"r{n}"] = []
        for i in range(draw.randint(1, 60)):
            level -= draw.choice([0, 0.5, 1.5])
            runs[f"r{n}"].append((i * 3, round(level + draw.choice([0, 0, 2, 4, -1]), 1) * (-1 if greater else 1)))
    df = spark.createDataFrame([(k, s, v) for k, rows in runs.items() for s, v in rows], "run_id string, step long, metric double")
    got = {r["run_id"]: r for r in training.early_stopping(df, patience, threshold, greater, block_width=20).collect()}
    assert got.keys() == runs.keys()
    for k, rows in runs.items():
        stop, best = brute_stop(rows, patience, threshold, greater)
        assert (got[k]["stop_step"], got[k]["best"]) == (stop, pytest.approx(best)), k
        assert got[k]["stopped"] == (stop is not None) and got[k]["evaluations"] == len(rows)


def test_threshold_paths_over_many_blocks(spark):
    """Runs that improve at every step, at the last moment, in one plunge, and not enough; many blocks and few."""
    draw = random.Random(5)
    runs = {
        "every": [(i, 1000.0 - i) for i in range(700)], "slow": [(i, 100 - i * 0.01) for i in range(600)],
        "plunge": [(i, 50 - i * 0.001 - (40 if i > 400 else 0)) for i in range(500)], "flat": [(i, 1.0) for i in range(300)],
        "edge": [(i, 10.0 - (i // 7) * 0.5) for i in range(300)], None: [(i, 5.0 - i * 0.3) for i in range(90)], "one": [(3, 1.0)],
    }
    for n in range(6):
        level, runs[f"r{n}"] = 90.0, []
        for i in range(draw.randint(50, 400)):
            level -= draw.choice([0, 0, 0.02, 0.3])
            runs[f"r{n}"].append((i * 2, round(level + draw.choice([0, 0, 1, 3]), 2)))
    df = spark.createDataFrame([(k, s, v) for k, rows in runs.items() for s, v in rows], "run_id string, step long, metric double")
    for patience, threshold, width in ((7, 0.5, 16), (40, 0.25, 16), (30, 2.0, 50), (1000, 0.1, 1000)):
        got = {r["run_id"]: r for r in training.early_stopping(df, patience, threshold, block_width=width).collect()}
        assert got.keys() == runs.keys()
        for k, rows in runs.items():
            stop, best = brute_stop(rows, patience, threshold, False)
            assert (got[k]["stop_step"], got[k]["best"]) == (stop, pytest.approx(best)), (k, patience)


def test_a_run_that_improves_at_every_step(spark):
    rows = spark.range(0, 40_000, numPartitions=4).selectExpr("'a' AS run_id", "id AS step", "CAST(-id AS double) AS metric")
    made = training.early_stopping(rows, 5, 0.5, block_width=1000).collect()
    assert [(r["evaluations"], r["best"], r["stop_step"]) for r in made] == [(40_000, -39_999.0, None)]


def test_early_stopping_in_batches_equals_one_batch(spark):
    draw = random.Random(1)
    rows = [(f"r{i % 5}" if i % 5 else None, i, round(50 - i * 0.05 + draw.choice([0, 1, 3, -2]), 2)) for i in range(300)]
    schema = "run_id string, step long, metric double"
    for patience, threshold in ((6, 0.0), (8, 0.5)):
        whole = training.early_stopping(spark.createDataFrame(rows, schema), patience, threshold, block_width=50)
        state = None
        for part in (rows[:4], rows[4:90], rows[90:200], rows[200:]):
            made = training.early_stopping_state(spark.createDataFrame(part, schema), state, patience, threshold, block_width=50)
            state = spark.createDataFrame(made.collect(), made.schema)
        fields = ["run_id", "evaluations", "best", "stop_step", "stopped"]
        assert sorted(map(str, state.select(fields).collect())) == sorted(map(str, whole.select(fields).collect()))


def test_metric_names(spark):
    df = spark.createDataFrame([("r", 1, {"eval_loss": 0.1, "loss": 0.2, "_x": 1.0, "grad": None, "eval_eval_a": 0.3})],
                               "run_id string, step long, logs map<string,double>")
    names = lambda d: sorted(r["metric"] for r in d.collect())
    assert names(training.rename_training_metrics(df)) == ["eval/eval_a", "eval/loss", "train/loss"]
    assert names(training.rename_eval_metrics(df)) == ["eval/_x", "eval/a", "eval/loss", "eval/loss"]


def test_perplexity_and_gate(spark):
    df = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 30), ("b", 5.0, 1)], "m string, loss double, tokens long")
    got = {r["m"]: r["perplexity"] for r in training.perplexity(df, ["m"]).collect()}
    assert got["a"] == pytest.approx(2.718281828 ** 1.75)
    gate = spark.createDataFrame([(60.0,), (50.0,), (None,)], "perplexity double")
    assert [r["register"] for r in training.register_gate(gate).collect()] == [False, True, True]


def test_health(spark):
    df = spark.createDataFrame([("r", 1, {"loss": 3.0}), ("r", 2, {"loss": 0.45, "eval_loss": 0.52, "samples_per_second": 15.2}),
                                ("r", 3, {"epoch": 1.0})], "run_id string, step long, logs map<string,double>")
    r = training.training_health(df).first()
    assert r["converged"] and r["no_overfit"] and r["fast_enough"]


def test_best_trial_and_space(spark):
    trials = spark.createDataFrame([("s", 1, 0.5, "COMPLETED"), ("s", 2, 0.3, "COMPLETED"), ("s", 3, 0.1, "FAILED")],
                                   "study string, trial_id long, metric double, status string")
    assert training.best_trial(trials, ["study"]).first()["trial_id"] == 2
    assert training.best_trial(trials, ["study"], mode="max").first()["trial_id"] == 1
    ids = spark.range(500).withColumnRenamed("id", "trial_id")
    space = {"r": ("choice", [8, 16]), "d": ("uniform", 0.0, 0.1), "lr": ("loguniform", 1e-5, 1e-3)}
    rows = training.sample_search_space(ids, space).collect()
    again = training.sample_search_space(ids.repartition(7), space).collect()
    assert sorted(rows) == sorted(again)
    assert {r["r"] for r in rows} == {8, 16} and all(0 <= r["d"] < 0.1 and 1e-5 <= r["lr"] <= 1e-3 for r in rows)


def test_stages(spark):
    moves = spark.createDataFrame([
        ("m", 1, "Production", 1), ("m", 2, "Staging", 2), ("m", 2, "Production", 3), ("m", 3, "Production", 4),
        ("m", 3, "Staging", 5)], "name string, version int, stage string, seq int")
    got = {r["version"]: r["stage"] for r in registry.current_stages(moves).collect()}
    assert got == {1: "Archived", 2: "Archived", 3: "Staging"}
    got = {r["version"]: r["stage"] for r in registry.current_stages(moves, archive_others=False).collect()}
    assert got == {1: "Production", 2: "Production", 3: "Staging"}


def test_rollback(spark):
    df = spark.createDataFrame([("m", 1, "v1", True), ("m", 2, "v2", False), ("m", 3, "v3", True), ("m", 4, "v4", False)],
                               "name string, seq long, version string, ok boolean")
    made = registry.rollback_target(df, F.col("ok"), block_width=2)
    assert [r["rollback_to"] for r in made.orderBy("seq").collect()] == [None, "v1", "v1", "v3"]


def test_lineage(spark):
    stages = spark.createDataFrame([("ingest", None), ("embed", "docs"), ("train", "lost")], "stage string, input string")
    arts = spark.createDataFrame([("docs",)], "artifact string")
    assert [r["stage"] for r in registry.lineage_gaps(stages, arts).collect()] == ["train"]
    edges = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("d", "a"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {(r["artifact"], r["ancestor"]): r["distance"] for r in registry.ancestors(edges).collect()}
    assert got["d", "a"] == 1 and got["d", "b"] == 2 and got["c", "a"] == 2
    assert got["x", "y"] == 1 and got["x", "x"] == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "child int, parent int").coalesce(1)
    assert registry.ancestors(chain).count() == 60 * 61 // 2


def test_throughput(spark):
    df = spark.createDataFrame([("ingest", 1000, 120.0), ("idle", 0, 0.0)], "stage string, items int, seconds double")
    got = {r["stage"]: r["items_per_second"] for r in registry.stage_throughput(df, ["stage"]).collect()}
    assert got == {"ingest": pytest.approx(8.3333333), "idle": None}


def test_lineage_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 2,000 is closed by doubling distances; a cycle ends."""
    frame, rounds = type(spark.range(1)), []
    held = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a: (rounds.append(1), held(self, *a))[1])
    n = 2000
    edges = spark.range(n).selectExpr("id AS child", "id + 1 AS parent")
    made = registry.ancestors(edges)
    assert len(rounds) <= 12 + 1  # and one for the links themselves
    assert made.count() == n * (n + 1) // 2
    assert made.filter("ancestor - artifact <> distance").isEmpty()
    ring = registry.ancestors(spark.range(7).selectExpr("id AS child", "(id + 1) % 7 AS parent"))
    assert sorted((r["artifact"], r["ancestor"], r["distance"]) for r in ring.collect()) == sorted(
        (a, (a + d) % 7, d) for a in range(7) for d in range(1, 8))


def test_tokenizer_hook(spark):
    """A real tokenizer file behind the hook, cut at 2,048 ids, loaded once per worker."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")

    def load():
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        return lambda texts: [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]

    texts = ["Some words here.", "", None, "word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    hook = training.Tokenizer("words", load, batch=2)
    got = {r.id: r for r in training.tokenize_truncate(df, "text", ["id"], tokenizer=hook).collect()}
    tok = tokenizers.Tokenizer.from_file(path)
    for k, text in enumerate(texts):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert (list(got[k].tokens), got[k].n_tokens, got[k].truncated) == (ids[:2048], min(len(ids), 2048), len(ids) > 2048)


def test_short_blocks_share_a_call(spark, tmp_path, monkeypatch):
    """Many runs with few records a block take few calls of Python, and stop where each alone would."""
    draw = random.Random(11)
    rows = [(r, s, draw.random() * 10) for r in [*range(60), None] for s in range(0, 400, 10)]
    df = spark.createDataFrame(rows, "run_id long, step long, metric double")
    log, plain = str(tmp_path / "calls"), training._shortened

    def counted(*args):
        with open(log, "a") as f:
            f.write("x")
        return plain(*args)

    monkeypatch.setattr(training, "_shortened", counted)
    got = {r.run_id: (r.best, r.stop_step) for r in training.early_stopping(df, 6, 0.5, block_width=40).collect()}
    want = {}
    for run in [*range(60), None]:
        best, misses, stop = None, 0, None
        for _, s, m in [x for x in rows if x[0] == run]:
            if best is None or m < best - 0.5:
                best, misses = m, 0
            else:
                misses += 1
                if misses >= 6:
                    stop = s
                    break
        want[run] = (best, stop)
    assert got == want
    assert len(open(log).read()) <= 20
