import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import align, batching, checkpoints, generate, guards, hooks, metrics as mt, ordering


def test_expand_placeholders(spark):
    a = tx.AUDIO
    texts = spark.createDataFrame([(0, f"a{a}b{a}"), (1, "c"), (2, a)], "k long, t string")
    lens = spark.createDataFrame([(0, 2), (1, 0)], "ordinal long, n long")
    got = {r["k"]: r["expanded"] for r in align.expand_placeholders(texts, lens, "k", "t").collect()}
    assert got == {0: f"a{a}{a}b{a}", 1: "c", 2: a}


def spans(spark, *rows):
    data = [(i, p, t) for i, row in enumerate(rows) for p, t in enumerate(row)]
    df = spark.createDataFrame(data, "s int, pos long, token string")
    out = align.label_spans(df, "s", "B", "E", ["asst", "n"]).where("labelled").orderBy("s", "pos").collect()
    return [[r["token"] for r in out if r["s"] == i] for i in range(len(rows))]


def test_label_spans(spark):
    full = ["B", "user", "n", "x", "E", "n", "B", "asst", "n", "y", "z", "E", "n"]
    got = spans(
        spark,
        full,
        full[:11] + ["n"],
        ["B", "user", "n", "x", "E"],
        ["B", "asst", "n", "E"],
        ["B", "asst", "n"],
        ["B", "asst", "n", "a", "B", "asst", "n", "b", "E", "c"],
        ["B", "asst", "n", "a", "E", "q", "B", "asst", "n", "b", "E", "q"],
    )
    assert got == [["y", "z", "E"], ["y", "z", "n"], [], ["E"], [], ["a", "B", "asst", "n", "b", "E"], ["a", "E", "b", "E"]]


def test_concat_frames(spark):
    df = spark.createDataFrame([(1, t, [float(t)]) for t in range(7)], "seq_id int, t long, vec array<float>")
    got = [(r["t"], r["vec"]) for r in align.concat_frames(df, 2).orderBy("t").collect()]
    assert got == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    arr = F.array(*[F.array(F.lit(t)) for t in range(7)])
    assert spark.range(1).select(align.concat_frames_array(arr, 2)).first()[0] == [[0, 1], [2, 3], [4, 5]]


def test_pad_transpose(spark):
    r = spark.range(1).select(align.pad(F.array(F.lit(1)), F.lit(3), F.lit(0)), align.pad(F.array(F.lit(1)), F.lit(3), F.lit(0), left=True), align.transpose(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))), align.unpad(F.array(F.lit(1), F.lit(0)), F.lit(1))).first()
    assert list(r) == [[1, 0, 0], [0, 0, 1], [[1, 3], [2, 4]], [1]]


def test_fixed_batches(spark):
    got = spark.range(5).groupBy(batching.fixed_batches(F.col("id"), 2).alias("b")).count().orderBy("b").collect()
    assert [r["count"] for r in got] == [2, 2, 1]


def test_fold_opens_batches(spark):
    df = spark.createDataFrame([(i, 1.0, v) for i, v in enumerate([300, 300, 100, 600, 50])], "id long, duration double, v long")
    rows = F.array_sort(F.collect_list(F.struct(F.col("id").alias("o"), "id", "v")))
    out = df.agg(rows.alias("r")).select(batching._fold(F.col("r"), 600, "bigint")).first()[0]
    assert out == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("drop", [False, True])
def test_bounded_batches(spark, drop):
    df = spark.range(500).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("id"), (F.col("id") % 37 + 0.5).alias("duration"), (F.col("id") * 7 % 90 + 1).alias("v"))
    out = batching.bounded_batches(df, "id", "duration", "v", 80, 6, 3, drop_last=drop)
    sums = out.groupBy("bucket", "run", "batch_id").agg(F.sum("v").alias("t"), F.count("*").alias("n")).collect()
    assert all(r["t"] <= 80 or r["n"] == 1 for r in sums)
    assert out.select("id").distinct().count() == out.count()
    assert (out.count() == 500) is not drop


def test_running_and_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = ordering.running(df, "s", ordering.id_bucket("k", 64), ["k"], value=F.col("k"), within=["g"]).collect()
    for r in got:
        assert r["s"] == sum(x["k"] for x in got if x["g"] == r["g"] and x["k"] <= r["k"])
    assert sorted(r["p"] for r in ordering.position(df, "p", ordering.id_bucket("k", 64), ["k"]).collect()) == list(range(1000))


def test_ntile_matches_window(spark):
    from pyspark.sql import Window

    for n in (3, 10, 64):
        df = spark.range(47).withColumn("w", F.ntile(n).over(Window.orderBy("id")).cast("long")).withColumn("t", ordering.ntile(F.col("id"), F.lit(47), n))
        assert df.where("w <> t").count() == 0


def test_ema_is_the_fold(spark):
    rows = [("m", s, float(s % 17)) for s in range(2000)]
    want = None
    for _, s, x in rows:
        if s % 100 == 0 and s:
            want = x if want is None else 0.9 * want + 0.1 * x
    got = mt.ema(spark.createDataFrame(rows, "name string, step long, value double"), "name", "step", "value", decay=0.9).first()["ema"]
    assert got == pytest.approx(want)


def test_token_accuracy_edges(spark):
    df = spark.createDataFrame([(1, 0, 5, -100), (1, 1, 9, 5), (1, 2, 0, 7), (2, 0, 1, -100)], "s int, pos int, p int, l int")
    got = {r["s"]: (r["correct"], r["total"], r["acc"]) for r in mt.token_accuracy(df, "s", "pos", "p", "l").collect()}
    assert got == {1: (1, 2, 0.5), 2: (0, 0, 0.0)}
    assert spark.range(1).select(mt.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))).first()[0] == 1


def test_empty_accuracy(spark):
    res = spark.createDataFrame([], "test_set string, hyp string, ref string")
    sets = spark.createDataFrame([("x",)], "test_set string")
    assert list(mt.qa_accuracy(res, sets).first()) == ["x", 0, 0, 0.0]


def test_guards(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    with pytest.raises(Exception, match="n is missing in b"):
        guards.require(df, "id", "n").collect()
    kept, rejected = guards.split_failed(df, F.col("n") > 5)
    assert (kept.count(), rejected.count()) == (1, 1)


def test_contains_any(spark):
    texts = spark.createDataFrame([(1, "xx one two three yy"), (2, "one twothree"), (3, "ab")], "d int, t string")
    items = spark.createDataFrame([(1, "x one two thr"), (2, "ab"), (3, "one two")], "i int, s string")
    assert sorted((r["d"], r["i"]) for r in guards.contains_any(texts, items, "t", "s").collect()) == [(1, 1), (1, 3), (2, 3), (3, 2)]


def test_checkpoints(spark):
    state = F.create_map(F.lit("module.a"), F.lit(1), F.lit("longer_b"), F.lit(2))
    assert spark.range(1).select(checkpoints.strip_map_prefix(state)).first()[0] == {"a": 1, "b": 2}
    with pytest.raises(Exception, match="give a filename"):
        checkpoints.resolve(spark.createDataFrame([(None, 0, None)], "filename string, iter long, epoch long"), "/e").collect()


def test_weighted_mux_shares(spark):
    df = spark.range(300).select(F.col("id").alias("k"), F.when(F.col("id") < 150, "a").otherwise("b").alias("s"), F.when(F.col("id") < 150, 2.0).otherwise(1.0).alias("w"))
    head = batching.weighted_mux(df, "s", "w", "k").where("rank < 90").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in head} == {"a": 60, "b": 30}


def test_generate(spark):
    df = spark.createDataFrame([(str(i), "p" * i) for i in range(1, 80)], "idx string, prompt string")
    got = generate.generate(df, "prompt", generate.echo(64), batch=8).collect()
    assert len(got) == 79
    assert {r["finish_reason"] for r in got if int(r["idx"]) <= 64} == {"stop"}


def test_last_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, p int, v string")
    assert {r["k"]: r["v"] for r in generate.last_by_key(df, "k", "p").collect()} == {"a": "z", "b": None}


def test_hooks(spark):
    df = spark.createDataFrame([("a b", [1.0]), (None, [2.0, 3.0])], "t string, s array<float>")
    got = hooks.tokenize(df, "t", lambda: lambda texts: [[len(w) for w in t.split()] for t in texts]).collect()
    assert sorted(r["input_ids"] for r in got) == [[], [1, 1]]
    out = hooks.extract_features(df, "s", lambda: lambda waves: ([[[float(x)] for x in w] for w in waves], [len(w) for w in waves])).collect()
    assert sorted(r["feature_len"] for r in out) == [1, 2]
    assert hooks.apply_all(df, [lambda d: d.where("t IS NOT NULL"), lambda d: d.select("t")]).columns == ["t"]
    assert hooks.freeze(["enc", "no"], ["enc.w", "encoder.w"]) == (["enc"], ["no"])


def test_top_p(spark):
    df = spark.createDataFrame([(1, [0.0, 5.0, 0.0]), (2, [1.0, 1.0, 1.0, 1.0]), (3, []), (4, None), (5, [-1e6])], "i int, s array<double>")
    places = lambda c: {r[0]: r[1] for r in df.select("i", F.transform(c, lambda x: x["place"])).collect()}
    assert places(hooks.top_p(F.col("s"), 0.5)) == {1: [1], 2: [0, 1], 3: [], 4: None, 5: [0]}
    assert places(hooks.top_p(F.col("s"), 1.0, 100.0, 2)) == {1: [1, 0], 2: [0, 1], 3: [], 4: None, 5: [0]}
    assert places(hooks.top_p(F.col("s"), 0.0))[2] == [0]


def test_merge(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}, {"b": 3, "c": None}), (2, None, {"a": 1}), (3, {"a": 1}, None), (4, {}, {})], "i int, x map<string,int>, y map<string,int>")
    got = {r[0]: r[1] for r in df.select("i", hooks.merge(F.col("x"), F.col("y"))).collect()}
    assert got == {1: {"a": 1, "b": 3, "c": None}, 2: {"a": 1}, 3: {"a": 1}, 4: {}}


def test_even_buckets(spark, monkeypatch):
    """Sparse, clustered and tied keys: no bucket over its share, positions as of one window."""
    monkeypatch.setattr(ordering, "even_bucket", lambda df, order, f=ordering.even_bucket: f(df, order, 100))
    sparse = spark.range(4000).select(F.when(F.col("id") < 2000, F.col("id") * 10**14).otherwise(F.col("id")).alias("k"), F.lpad(F.col("id").cast("string"), 5, "0").alias("s"))
    tied = spark.range(4000).select(F.when(F.col("id") % 4 < 3, 7.5).otherwise(F.col("id") / 3).alias("k"), F.concat(F.lit('"é'), F.lpad(F.col("id").cast("string"), 5, "0")).alias("s"))
    for df in (sparse, tied):
        bucket = ordering.even_bucket(df, ["k", "s"])
        sizes = [r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()]
        assert len(sizes) > 20 and max(sizes) < 400
        got = ordering.position(df, "p", None, ["k", "s"]).collect()
        assert [(r["k"], r["s"]) for r in sorted(got, key=lambda r: r["p"])] == sorted((r["k"], r["s"]) for r in got)
        assert sorted(r["p"] for r in got) == list(range(4000))
    assert ordering.even_bucket(sparse.limit(150), ["k"]) is None


def test_place(spark):
    bounds = F.array(*[F.lit(x) for x in (3, 5, 5, 9, 20)])
    got = spark.range(25).select("id", ordering.place(bounds, F.col("id"), 5).alias("n")).collect()
    assert [r["n"] for r in got] == [sum(b <= r["id"] for b in (3, 5, 5, 9, 20)) for r in got]


def test_contains_any_with_key(spark):
    texts = spark.createDataFrame([(1, "xx one two three yy"), (2, "one twothree"), (3, "ab"), (4, None), (5, "")], "d int, t string")
    items = spark.createDataFrame([(1, "x one two thr"), (2, "ab"), (3, "one two"), (4, "b"), (5, "two three yy")], "i int, s string")
    got = guards.contains_any(texts, items, "t", "s", "d")
    assert sorted((r["d"], r["i"]) for r in got.collect()) == [(1, 1), (1, 3), (1, 5), (2, 3), (3, 2), (3, 4)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_large_vocabulary(spark, small, monkeypatch):
    from tessera.plans import views

    want = sorted(views.token_ids(spark, small).collect())
    monkeypatch.setattr(views, "VOCABULARY", 0)
    cols = ["token", "seq_id", "pos", "token_id"]
    assert sorted(views.token_ids(spark, small).select(*cols).collect()) == sorted(spark.createDataFrame(want).select(*cols).collect())


def test_check_inputs():
    guards.check_inputs("t", audio=1)
    with pytest.raises(ValueError, match="text is required"):
        guards.check_inputs(None)
    with pytest.raises(ValueError, match="not both"):
        guards.check_inputs("t", 1, 2)


def test_decode(spark):
    df = spark.createDataFrame([([104, 105],), ([],), (None,)], "ids array<int>")
    got = hooks.decode(df, "ids", lambda: lambda rows: ["".join(map(chr, r)) for r in rows]).collect()
    assert [r["text"] for r in got] == ["hi", "", ""]


def test_options(spark):
    assert [hooks.number_type(x) for x in ("fp16", "bf16", "fp32")] == ["float16", "bfloat16", "float32"]
    assert hooks.decode_options("greedy_search")["num_beams"] == 1
    assert hooks.decode_options("beam_search", 256) == {"max_new_tokens": 256, "num_beams": 4, "do_sample": False}
    df = spark.createDataFrame([(None,), ({"model_type": "x", "d": "1"},), ({"d": "2"},)], "c map<string,string>")
    got = [r[0] for r in df.select(hooks.resolve_config(F.col("c"), "w")).collect()]
    assert got == [{"model_type": "w"}, {"model_type": "x", "d": "1"}, {"model_type": "w", "d": "2"}]


def test_progress(spark):
    rows, seen = mt.with_progress(spark.range(30))
    rows.collect()
    assert seen.get["rows"] == 30


def test_process_without_clips(spark):
    from tessera.plans import paths

    df = spark.createDataFrame([(1, f"{tx.BEGIN}user\n{tx.AUDIO}a{tx.END}\n{tx.BEGIN}assistant\nb c{tx.END}\n")], "k long, t string")
    got = paths.process(df, "k", "t").orderBy("pos").collect()
    assert [r["token"] for r in got if r["labelled"]] == ["b", "c", tx.END]
    assert sum(r["token"] == tx.AUDIO for r in got) == 1
    audio = spark.createDataFrame([(0, 800)], "ordinal long, frames long")
    assert paths.process(df, "k", "t", audio=audio, labels=False).where(F.col("token") == tx.AUDIO).count() == 100
    with pytest.raises(ValueError):
        paths.process(df, "k", "t", audio=audio, features=audio)


@pytest.mark.parametrize("width", [None, 60])
def test_null_keys_lose_no_row(spark, monkeypatch, width):
    """Null groups, ids and weights below and above the size from which rows are dealt into buckets."""
    if width:
        monkeypatch.setattr(ordering, "WIDTH", width)
        monkeypatch.setattr(ordering, "even_bucket", lambda df, order, f=ordering.even_bucket: f(df, order, width))
    null = lambda c, n: F.when(F.col("id") % n != 0, c)
    df = spark.range(1000).select("id", null(F.concat(F.lit("g"), F.col("id") % 3), 10).alias("g"), null(F.col("id"), 4).alias("k"), null(F.lit(2.0), 4).alias("w"), (F.col("id") % 37 / 3.7).alias("d"), F.lit(5).cast("long").alias("v"), F.col("id").alias("step"))
    rows = df.collect()
    at = {r["id"]: r["p"] for r in ordering.position(df, "p", None, ["id"], within=["g"]).collect()}
    for g in {r["g"] for r in rows}:
        assert [at[r["id"]] for r in rows if r["g"] == g] == list(range(sum(r["g"] == g for r in rows)))
    assert sorted(r["rank"] for r in batching.seeded_shuffle(df, 3, "k").collect()) == list(range(1000))
    mixed = batching.weighted_mux(df, "g", "w", "k").collect()
    assert sorted(r["rank"] for r in mixed) == list(range(1000))
    assert {r["rank"] < 250 for r in mixed if r["w"] is None} == {True}
    zero = batching.weighted_mux(df.withColumn("w", F.lit(0)), "g", "w", "id").collect()
    assert sorted(r["rank"] for r in zero) == list(range(1000))
    batches = batching.bounded_batches(df, "k", "d", "v", 40, 5, 1).collect()
    assert len(batches) == 1000 and sum(r["k"] is None for r in batches) == 250
    averages = {r["g"]: r["ema"] for r in mt.ema(df, "g", "step", "d", 0.5, 10).collect()}
    assert averages.keys() == {None} | {f"g{i}" for i in range(3) if any(r["g"] == f"g{i}" and r["step"] % 10 == 0 for r in rows)}
    windows = mt.accumulation_windows(df, "g", "step", "d", 7).collect()
    assert sum(r["g"] is None for r in windows) == -(-100 // 7)
    norms = mt.clip_norm(df, "g", "d", 1.0).collect()
    assert len(norms) == 1000
    packed = align.pack(df, F.lit(True), "g", "id").collect()
    assert sorted(r["packed_pos"] for r in packed) == list(range(1000))


def test_null_values_add_nothing(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(10)], "id long, x long")
    got = ordering.running(df, "s", None, ["id"], value=F.col("x")).orderBy("id").collect()
    assert [r["s"] for r in got] == [0, 0, 2, 2, 6, 6, 12, 12, 20, 20]
