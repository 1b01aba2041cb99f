import math

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from gramframe.functions import text as X
from gramframe.operators import counts, huffman, loglinear, smoothing, train
from gramframe.plans import catalog as Q
from gramframe.plans import experiment, queries
from gramframe.plans.queries import noise_of
from gramframe.sources import corpus as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def toy(spark):
    return C.tokenized(spark.createDataFrame([(1, "a b a c\na b b\nc a b")], "doc_id long, text string"))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_oracle(spark, name):
    assert oracle.compare(Q.QUERIES[name](spark, SF), oracle.connect(SF), Q.ORACLE_SQL[name]) is None


def test_trigram_model_on_the_toy_corpus(spark, toy):
    want = {(None, None, "a"): 1 / 3, (None, "<s>", "a"): 0.483333333, (None, "a", "b"): 0.648148148, ("<s>", "a", "b"): 0.982407407, ("a", "b", "a"): 0.325, ("b", "a", "b"): 0.064814815, ("c", "c", "a"): 0.483333333}
    grams = spark.createDataFrame(list(want), "u string, v string, w string")
    for r in smoothing.trigram_score(grams, smoothing.trigram_model(toy)).collect():
        assert r["p"] == pytest.approx(want[r["u"], r["v"], r["w"]], abs=1e-8) and r["log_prob"] == pytest.approx(math.log(r["p"]))


def test_kneser_ney_on_the_toy_corpus(spark, toy):
    want = {("<s>", "a", "b"): 0.98237037, ("a", "b", "a"): 0.324916667, ("b", "a", "b"): 0.064740741, ("c", "c", "a"): 0.482222222, ("a", "b", "zzz"): 0}
    for r in smoothing.kneser_ney_score(spark.createDataFrame(list(want), "w1 string, w2 string, w3 string"), smoothing.kneser_ney(toy)).collect():
        assert r["p"] == pytest.approx(want[r["w1"], r["w2"], r["w3"]], abs=1e-8)
        assert (r["log_prob"] is None) == (r["p"] == 0)


def test_features(spark):
    row = spark.range(1).select(F.split(F.lit("a b c"), " ").alias("x"), F.split(F.lit("v w x y z"), " ").alias("y"), F.array(F.lit("a")).alias("z"))
    got = row.select(X.ngram_features(2, 3)(F.col("x")), X.skip_features(F.col("x")), X.skip_features(F.col("y")), X.skip_features(F.col("z")), X.product(lambda a: F.array(F.lit("x"), F.lit("y")), lambda a: F.array(F.lit("p"), F.lit("q"), F.lit("r")))(F.col("x")), X.ngrams(F.col("z"), 2)).first()
    assert got[0] == ["NGRAM__b", "NGRAM__a__b"] and got[1] == ["SKIP__a_0"] and got[2] == ["SKIP__v_0", "SKIP__w_1", "SKIP__x_2"] and got[3] == []
    assert got[4] == ["PROD(x,p)", "PROD(x,q)", "PROD(x,r)", "PROD(y,p)", "PROD(y,q)", "PROD(y,r)"] and got[5] == []


def test_suffix_backoff(spark):
    words = spark.createDataFrame([("walking",), ("talking",), ("king",), ("sing",), ("cat",)], "word string")
    of = lambda n: {r[0]: r[1] for r in counts.suffix_backoff(words, counts.suffix_counts(words), n).collect()}
    assert of(3) == {"walking": "king", "talking": "king", "king": "king", "sing": "ing", "cat": ""}
    assert set(of(6).values()) == {"UNK"}


def test_huffman_codes_read_from_leaf_to_root():
    assert huffman.codes_of({"a": 6, "b": 3, "c": 2, "d": 1.5}) == {"a": "0", "b": "01", "c": "111", "d": "011"}
    codes = huffman.codes_of({str(i): i + 1 for i in range(20)})
    assert sum(2.0 ** -len(c) for c in codes.values()) == 1


VOCAB = [(0, 4), (1, 2), (2, 3)]


@pytest.fixture(scope="module")
def small(spark):
    pairs = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 2, 2)], "ctx long, word_id long, n long")
    contexts = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 2)], "ctx long, fid long")
    vocab = spark.createDataFrame(VOCAB, "word_id long, c long")
    noise = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2), (0, 1, 0, 0), (1, 2, 0, 0), (1, 2, 1, 2)], "ctx long, word_id long, j long, noise_id long")
    q = vocab.select("word_id", (F.col("c") / 9).alias("q"))
    codes = spark.createDataFrame([(0, "0"), (1, "01"), (2, "11")], "word_id long, code string")
    nodes = spark.createDataFrame([("", 1), ("1", 2)], "node string, node_id long")
    return pairs, contexts, vocab, noise, q, codes, nodes


@pytest.mark.parametrize("kind", ["self_normalized", "exact", "nce", "sampled", "low_rank", "hierarchical", "hierarchical_without_const"])
def test_gradients_agree_with_differences(small, kind):
    pairs, contexts, vocab, noise, q, codes, nodes = small
    L = loglinear
    value, gradient = {
        "self_normalized": (lambda t: L.self_normalized(pairs, contexts, vocab, 0.1, t), lambda: L.self_normalized_gradient(pairs, contexts, vocab, 0.1)),
        "exact": (lambda t: L.self_normalized(pairs, contexts, vocab, 0.0, t), lambda: L.self_normalized_gradient(pairs, contexts, vocab, 0.0)),
        "nce": (lambda t: L.nce(pairs, noise, contexts, q, 2, t), lambda: L.nce_gradient(pairs, noise, contexts, q, 2)),
        "sampled": (lambda t: L.sampled_softmax(pairs, noise, contexts, t), lambda: L.sampled_softmax_gradient(pairs, noise, contexts)),
        "low_rank": (lambda t: L.low_rank(pairs, noise, contexts, 3, t), lambda: L.low_rank_gradient(pairs, noise, contexts, 3)),
        "hierarchical": (lambda t: L.hierarchical_objective(pairs, contexts, codes, nodes, t), lambda: L.hierarchical_gradient(pairs, contexts, codes, nodes)),
        "hierarchical_without_const": (lambda t: L.hierarchical_objective(pairs, contexts, codes, nodes, t, False), lambda: L.hierarchical_gradient(pairs, contexts, codes, nodes, const=False)),
    }[kind]
    grad = {r["pid"]: r["g"] for r in gradient().collect()}
    eps = 1e-5
    for pid in sorted(grad, key=lambda k: -abs(grad[k]))[:2]:
        at = lambda e, pid=pid: value(lambda p: L.theta_of(p) + F.when(p == pid, e).otherwise(0.0)).first()[0]
        assert (at(eps) - at(-eps)) / (2 * eps) == pytest.approx(grad[pid], rel=1e-5)


def test_plain_objective_with_four_parameters():
    """A weight belongs in the gradient as in the objective."""
    x, weight = np.array([0.3, -0.2, 0.5, 0.1]), np.array([1.0, 10.0, 1.0, 10.0])
    f = lambda t: float((weight * (np.log1p(np.exp(t)) - t * (weight > 1))).sum())
    g = weight * (1 / (1 + np.exp(-x)) - (weight > 1))
    step = np.eye(4) * 1e-6
    assert [(f(x + s) - f(x - s)) / 2e-6 for s in step] == pytest.approx(g, rel=1e-6)


@pytest.mark.parametrize("l1", [False, True])
def test_training_raises_the_likelihood_and_survives_a_round_trip(spark, small, tmp_path, l1):
    pairs, contexts, vocab = small[:3]
    told = []
    theta, history = train.sgd(pairs.withColumn("group_id", F.col("ctx")), contexts, vocab, train.Training(steps=6, l1=l1, monitor_every=2), lambda *x: told.append(x))
    assert history[-1] > history[0] and np.isfinite(theta).all() and [t[0] for t in told] == [0, 2, 4] and told[0][2] == pytest.approx(math.exp(-history[0]))
    C.save_model(str(tmp_path / "m"), {"steps": 6}, theta=train.parameters(spark, theta), vocab=vocab)
    config, tables = C.load_model(spark, str(tmp_path / "m"))
    got = {(r["ctx"], r["word_id"]): r["score"] for r in train.unnormalized_scores(pairs, contexts, tables["theta"]).collect()}
    ids = lambda w, fids: [(w * 73856093 + f * 19349663) % loglinear.BUCKETS for f in fids]
    assert config == {"steps": 6} and got[0, 1] == pytest.approx(theta[ids(1, [0, 1])].sum()) and got[1, 2] == pytest.approx(theta[ids(2, [0, 2])].sum())


def test_every_word_can_be_noise(spark):
    vocab = spark.createDataFrame([(0, 1_000_000), *((i, 1) for i in range(1, 40))], "word_id long, c long")
    pairs = spark.createDataFrame([(i, 0, 1) for i in range(50)], "ctx long, word_id long, n long")
    noise, q = noise_of(pairs, vocab, k=3, slots=10)
    assert noise.count() == 150 and q.agg(F.sum("q")).first()[0] == pytest.approx(1)
    even = spark.createDataFrame([(i, 2) for i in range(40)], "word_id long, c long")
    assert noise_of(pairs, even, k=20, slots=3)[0].select("noise_id").distinct().count() == 40


def test_balanced_codes_have_the_bits_they_need(spark):
    from gramframe.plans.queries import balanced_codes

    rows = balanced_codes(spark.createDataFrame([(0,), (65536,), (131071,)], "word_id long")).collect()
    assert len({r["code"] for r in rows}) == 3 and {len(r["code"]) for r in rows} == {17}


def test_packed_ids_do_not_spill(spark):
    row = spark.createDataFrame([((1 << 20) - 1, 0, 5)], "a long, b long, c long")
    assert row.select(X.pack_ids(F.col("a"), F.col("b"), F.col("c"))).first()[0] == 1 + (((1 << 20) - 1) << 1) + (5 << 41)
    with pytest.raises(Exception, match="over the bits"):
        row.select(X.pack_ids(F.col("a") + 1)).collect()


def test_windows_cost_in_proportion_to_the_line(spark):
    import time

    took = {}
    for n in (8_000, 8_000, 64_000):
        docs = spark.createDataFrame([(1, " ".join(f"w{i % 97}" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert counts.word_columns(C.tokenized(docs), 3).agg(F.sum("c")).first()[0] == n
        took[n] = time.time() - began
    assert took[64_000] < 8 * took[8_000] + 2


def test_column_helpers(spark):
    row = spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("a"), F.array(F.lit(10), F.lit(20)).alias("b"), F.array(F.lit("x"), F.lit("y")).alias("w"), F.array(F.lit(3), F.lit(-1), F.lit(4)).alias("i"))
    got = row.select(X.cross(F.col("a"), F.col("b"), lambda x, y: x + y), X.scaled_add(F.col("a"), 2, F.col("b")), X.filled(2, 3, F.lit(0)), X.left_context(F.col("w"), 2, "S"), X.known_ids(F.col("i")), X.joined_ids(F.col("i")), X.parse_hash_name(X.hash_name(F.lit(7))), X.parse_hash_name(F.lit("other"))).first()
    assert list(got) == [[11, 21, 12, 22], [21, 42], [[0, 0, 0], [0, 0, 0]], [["S", "S"], ["x", "S"]], [3, 4], "3_-1_4", 7, None]


def test_experiment(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("trainPath: /a # where\nlines: 5\n")
    config = experiment.Config.from_args(["--config", str(tmp_path / "c.yaml"), "--min-word-count", "3"])
    assert (config.train_path, config.lines, config.min_word_count, config.epochs) == ("/a", 5, 3, 10)
    with pytest.raises(ValueError):
        experiment.Config.of({"nothing": "1"})
    stages = (experiment.Step("count", lambda s, c, made: {"n": s.range(c.lines).count()}), experiment.Step("double", lambda s, c, made: {"m": 2 * made["n"]}))
    assert experiment.Experiment(stages).run(spark, config) == {"n": 5, "m": 10}
    index = experiment.Index(spark.createDataFrame([("a", 0), ("b", 1)], "key string, id long"))
    asked = index.apply(spark.createDataFrame([("b",), ("z",)], "word string"), "word")
    assert index.size() == 2 and {(r["word"], r["id"]) for r in asked.collect()} == {("b", 1), ("z", -1)} and {r["key"] for r in index.unapply(asked).collect()} == {"b", None} and dict(index.pairs()) == {"a": 0, "b": 1}
    scored = smoothing.ExternalScorer(spark.createDataFrame([("b", -2.0)], "word string, log10p double"))
    assert isinstance(scored, experiment.LanguageModel) and {r["word"]: r["p"] for r in scored.score(asked.select("word")).collect()} == {"b": pytest.approx(0.01), "z": None}


def test_lines_of_files_over_several_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} line {i}\n" for i in range(400)))
    import gzip

    (tmp_path / "c.txt.gz").write_bytes(gzip.compress(b"".join(b"c line %d\n" % i for i in range(400))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        rows = C.text_lines(spark, str(tmp_path)).collect()
        some = C.text_lines(spark, str(tmp_path), 300).groupBy("doc_id").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 1200 and all(r["line"].endswith(f"line {r['line_no']}") for r in rows) and [r["count"] for r in some] == [300] * 3


def test_runs_groups_and_words(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    runs = [spark.createDataFrame(rows, "suffix string, word string, c long") for rows in ([("1_2", "a", 3), ("1", "b", 1)], [("1", "b", 4)])]
    for i, r in enumerate(runs):
        C.save_count_runs(r, at(f"r{i}"))
    C.copy_run(spark, at("r1"), at("r1copy"))
    assert spark.read.text(at("r0")).collect()[0][0] == "1,b,1"
    merged = counts.merge_runs(*C.load_count_runs(spark, at("r0"), at("r1copy")))
    assert {tuple(r) for r in merged.collect()} == {("1_2", "a", 3), ("1", "b", 5)}
    C.save_groups(spark.createDataFrame([(0, "x"), (1, "y"), (1, "z")], "group_id long, line string"), at("g"))
    assert {r["line"] for r in C.load_groups(spark, at("g"), [1]).collect()} == {"y", "z"}
    C.save_text(spark.createDataFrame([("b",), ("",)], "word string"), at("words"), "word")
    assert [r[0] for r in C.word_list(spark, at("words")).collect()] == ["b"]
    assert [r[0] for r in C.piped_scores(spark.createDataFrame([("w=3\t2\t-1.5",)], "line string"), "cat").collect()] == ["w=3\t2\t-1.5"]


def test_sources(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a b \n\n c  d\n")
    rows = C.text_lines(spark, str(tmp_path / "x.txt")).orderBy("line_no").select(C.tokens(F.col("line"), strict=True), C.tokens(F.col("line"), trim=True)).collect()
    assert [r[0] for r in rows] == [["a", "b"], [], ["", "c", "", "d"]] and rows[2][1] == ["c", "d"]
    out = spark.createDataFrame([("w=3\t2\t-1.5",), ("Total: 3",)], "line string")
    assert [tuple(r) for r in C.external_scores(out).collect()] == [("w", -1.5)]
    C.save_text(spark.createDataFrame([("f", 0.5)], "name string, weight double"), str(tmp_path / "w"), "name", "weight")
    assert spark.read.text(str(tmp_path / "w")).first()[0] == "f 0.5"


def test_once_finds_its_value_once_a_row(spark):
    runs = lambda of: F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: of))
    for r in spark.range(5).select(X.once(F.rand(), runs).alias("x")).collect():
        assert len(r["x"]) == 1
    assert spark.range(1).select(X.once(F.lit(None).cast("int"), lambda x: F.coalesce(x, F.lit(7)))).first()[0] == 7


def test_log_sum_exp_does_not_overflow(spark):
    got = spark.createDataFrame([([1000.0, 1000.0, -1000.0],), ([0.5],), ([-800.0, -801.0],)], "x array<double>").select(loglinear.log_sum_exp(F.col("x"))).collect()
    for r, want in zip(got, (1000 + math.log(2), 0.5, -800 + math.log1p(math.exp(-1)))):
        assert r[0] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("wide", [0.1, 30.0])
def test_transforms_agree_with_sums_over_words(monkeypatch, wide):
    """Bags of one to three features, some many times over; of parameters far apart, sums too small for a transform go by words."""
    from gramframe.operators import correlation

    rng = np.random.default_rng(3)
    theta, words = rng.normal(0, wide, correlation.BUCKETS), np.arange(700)
    bags = [[0], [5, 5]] + [[0, int(f)] for f in range(1, 400)] + [[0, 7, int(f)] for f in range(8, 300)]
    m = rng.integers(1, 1000, len(bags))
    plain = correlation.Scores(theta, words)
    want, (value, grad, met) = plain.log_z(bags), plain.model(bags, m, 0.1)
    monkeypatch.setattr(correlation, "CELLS", 10_000)
    monkeypatch.setattr(correlation.Scores, "_chunks", lambda self, n: iter([slice(0, n)]))
    assert plain._many(range(100))
    got, (value2, grad2, met2) = plain.log_z(bags), plain.model(bags, m, 0.1)
    assert np.abs(got - want).max() < 1e-9 and value2 == pytest.approx(value, rel=1e-12) and (met == met2).all()
    assert np.abs(grad2 - grad).max() < 1e-9 * np.abs(grad).max()
    for bag, z in zip(bags[:3], want):
        s = sum(theta[(words * 73856093 + f * 19349663) % correlation.BUCKETS] for f in bag)
        assert z == pytest.approx(s.max() + np.log(np.exp(s - s.max()).sum()))


def test_partition_functions_of_many_contexts_make_no_product(spark):
    """200,000 contexts of 20,000 words, four thousand million scores."""
    import time

    contexts = spark.range(1, 200_001).select(F.col("id").alias("ctx"), F.explode(F.array(F.lit(0).cast("long"), "id")).alias("fid"))
    began = time.time()
    z = {r[0]: r[1] for r in loglinear.log_partition(contexts, spark.range(20_000).withColumnRenamed("id", "word_id")).where("ctx % 50000 = 7").select("ctx", "logz").collect()}
    assert time.time() - began < 30 and len(z) == 4
    w = np.arange(20_000)
    theta = lambda p: (p * 37 % 101 - 50) / 500
    for f, logz in z.items():
        assert logz == pytest.approx(np.log(np.exp(theta(w * 73856093 % loglinear.BUCKETS) + theta((w * 73856093 + f * 19349663) % loglinear.BUCKETS)).sum()), abs=1e-11)


def test_gradient_of_many_contexts_makes_no_product(spark):
    """The same size; the gradient of the exact objective is as large in the data as in the model, and one of its parts is summed by hand."""
    import time

    pairs = spark.range(1, 200_001).select(F.col("id").alias("ctx"), (F.col("id") % 20_000).alias("word_id"), (1 + F.col("id") % 5).alias("n"))
    contexts = pairs.select("ctx", F.explode(F.array(F.lit(0).cast("long"), "ctx")).alias("fid"))
    began = time.time()
    g = {r[0]: r[1] for r in loglinear.self_normalized_gradient(pairs, contexts, spark.range(20_000).withColumnRenamed("id", "word_id"), 0.0).collect()}
    assert time.time() - began < 40 and len(g) == loglinear.BUCKETS and sum(g.values()) == pytest.approx(0, abs=1e-4)
    w, f, pid = np.arange(20_000), np.arange(1, 200_001), 123_456
    theta, at = (lambda p: (p % loglinear.BUCKETS * 37 % 101 - 50) / 500), w * 73856093 % loglinear.BUCKETS
    z = {c: np.exp(theta(at) + theta(at + c * 19349663)).sum() for c in f[np.isin((pid - f * 19349663) % loglinear.BUCKETS, at)]}
    place = {int(a): int(i) for i, a in enumerate(at)}
    assert pid not in place
    want = sum((1 + c % 5) * ((i == c % 20_000) - np.exp(theta(at[i]) + theta(pid)) / s) for c, s in z.items() for i in [place[int((pid - c * 19349663) % loglinear.BUCKETS)]])
    assert g[pid] == pytest.approx(want, rel=1e-9)


def test_external_scores_of_words_with_the_marks_of_the_format(spark, tmp_path):
    words = ["=", "a=b", "x=1\t2", "r s", "c\r", "plain"]
    rows = spark.createDataFrame([(f"{w}=1\t2\t-0.500000",) for w in words] + [("perplexity 3",), ("=1\t2\t-0.5",)], "line string")
    assert sorted(map(tuple, C.external_scores(rows).collect())) == sorted((w, -0.5) for w in words)
    text = "\n".join(f"= a=b plain {'x' if i % 3 else 'y\tz'} r s" for i in range(150))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    name = "external_scores_perplexity"
    assert oracle.compare(Q.QUERIES[name](spark, str(tmp_path)), con, Q.ORACLE_SQL[name]) is None


def test_packed_ids_with_a_carry(spark):
    """As DuckDB adds them up; what is beyond a long is an error in both."""
    big, con = 1 << 20, oracle.duckdb.connect()
    rows = [(big + 5, big, big - 1), (3 * big, 0, 4 * big - 1), (None, 2 * big, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long, c long").coalesce(1).select(X.pack_ids(F.col("a"), F.col("b"), F.col("c"), carry=True)).collect()]
    sql = "SELECT 1 + coalesce(a << 1, 0) + coalesce(b << 21, 0) + coalesce(c << 41, 0) FROM (SELECT ?::BIGINT AS a, ?::BIGINT AS b, ?::BIGINT AS c)"
    assert got == [con.execute(sql, r).fetchone()[0] for r in rows]
    for r in [(0, 0, 4 * big), (3 * big, 4 * big, 4 * big - 1)]:
        with pytest.raises(Exception, match="over"):
            spark.createDataFrame([r], "a long, b long, c long").select(X.pack_ids(F.col("a"), F.col("b"), F.col("c"), carry=True)).collect()
        with pytest.raises(oracle.duckdb.OutOfRangeException):
            con.execute(sql, r).fetchone()


def test_line_ids_of_frequent_and_rare_words(spark):
    lines = [["a", "b", "c", "a"], ["c", "d", "c"], ["a"], [f"w{i % 300}" for i in range(3000)], ["d", "a", "d"]]
    rows = spark.createDataFrame([(i // 2, i % 2, w) for i, w in enumerate(lines)], "doc_id long, line_no int, words array<string>").coalesce(2)
    ids = {w: i for i, w in enumerate(["a", "b", "c", "d", *[f"w{i}" for i in range(300)]])}
    table = spark.createDataFrame(list(ids.items()), "word string, word_id long")
    for frequent in (0, 3, 100, 1000):
        got = {(r[0], r[1]): r[2] for r in counts.line_ids(rows, table, frequent).collect()}
        assert got == {(i // 2, i % 2): [ids[x] for x in w] for i, w in enumerate(lines)}


def test_packed_keys_of_texts_with_the_marks_as_words(spark, tmp_path):
    spark.createDataFrame([(1, "a <s> b a\n\n</s> a"), (2, "b </s>")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(Q.QUERIES["packed_keys"](spark, str(tmp_path)), con, Q.ORACLE_SQL["packed_keys"]) is None


def test_ids_packed_wide(spark):
    rows = [(1 << 20, 3 << 20, (1 << 22) - 1), (0, 0, 1 << 22), (3 << 20, 1 << 22, (1 << 22) - 1), (None, 1 << 40, None), (9, 8, 7), (None, None, None), ((1 << 63) - 1,) * 3]
    df = spark.createDataFrame(rows, "a long, b long, c long").coalesce(1).select(X.pack_ids_wide(F.col("a"), F.col("b"), F.col("c")).alias("key"))
    assert df.dtypes == [("key", "decimal(38,0)")]
    assert [int(r[0]) for r in df.collect()] == [1 + ((a or 0) << 1) + ((b or 0) << 21) + ((c or 0) << 41) for a, b, c in rows]


WIDE_SQL = Q.ORACLE_SQL["packed_keys"].replace("word_id << ", "word_id::HUGEINT << ")


@pytest.mark.parametrize("third", [True, False])
def test_packed_keys_beyond_a_long(spark, tmp_path, third):
    """Places of 30 bits leave the third word two, so that few words do what 2^22 do in places of 20. Words that only begin lines are never third, and SQL has a result."""
    text = "\n".join(["a b c", "a b c", "a b", "a", *[f"a w{i} d" if third else f"w{i}" for i in range(40)]])
    spark.createDataFrame([(1, text), (2, "a </s>"), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, sql = queries.trigram_keys(queries.corpus(spark, str(tmp_path)), bits=30), [x.replace("<< 21", "<< 31").replace("<< 41", "<< 61") for x in (Q.ORACLE_SQL["packed_keys"], WIDE_SQL)]
    assert dict(got.dtypes)["key"] == ("decimal(38,0)" if third else "bigint")
    assert oracle.compare(got.withColumn("key", F.col("key").cast("decimal(38,0)")), con, sql[1]) is None
    if third:
        with pytest.raises(oracle.duckdb.OutOfRangeException):
            con.sql(sql[0]).fetchall()
    else:
        assert oracle.compare(got, con, sql[0]) is None


def test_packed_keys_of_a_vocabulary_over_the_bound(spark, tmp_path):
    """The word a and once w0000001 to w4194303, whose ids are the same numbers: the last id is just within the third place, but the one before it runs over into it."""
    con = oracle.duckdb.connect()
    con.sql(f"""COPY (SELECT i // 100000 AS doc_id, string_agg('a w' || printf('%07d', i), ' ' ORDER BY i) || CASE WHEN max(i) = 4194302 THEN ' w4194303' ELSE '' END AS text
 FROM (SELECT unnest(range(1, 4194303)) AS i) GROUP BY ALL) TO '{tmp_path}/documents.parquet'""")
    Q.QUERIES["packed_keys"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    rows = "SELECT count(*), sum(key), bit_xor(hash(doc_id, line_no, pos, key)) FROM (SELECT doc_id, line_no::BIGINT AS line_no, pos, key::HUGEINT AS key FROM {})"
    assert con.sql(rows.format(f"'{tmp_path}/out/*.parquet'")).fetchall() == con.sql(rows.format(f"({WIDE_SQL})")).fetchall()
    with pytest.raises(oracle.duckdb.OutOfRangeException):
        con.sql(f"SELECT sum(key) FROM ({Q.ORACLE_SQL['packed_keys']})").fetchall()


@pytest.mark.parametrize("name", ["sn_objective", "exact_objective", "softmax_logprob"])
def test_objectives_of_many_contexts_make_no_product(spark, name):
    """200,000 contexts of 20,000 words, each with one pair of its own."""
    import time

    n, words = 200_000, np.arange(20_000)
    pairs = spark.range(1, n + 1).select(F.col("id").alias("ctx"), (F.col("id") % 20_000).alias("word_id"), F.lit(2).cast("long").alias("n"))
    contexts = pairs.select("ctx", F.explode(F.array(F.lit(0).cast("long"), "ctx")).alias("fid"))
    vocab = spark.range(20_000).withColumnRenamed("id", "word_id")
    theta, at = (lambda p: (p % loglinear.BUCKETS * 37 % 101 - 50) / 500), words * 73856093
    z = lambda c: np.log(np.exp(theta(at) + theta(at + c * 19349663)).sum())
    score = lambda c: theta(at[c % 20_000]) + theta(at[c % 20_000] + c * 19349663)
    began = time.time()
    if name == "softmax_logprob":
        got = loglinear.softmax_logprob(pairs, contexts, vocab).where("ctx % 50000 = 9").select("ctx", "log_prob").collect()
        assert len(got) == 4 and all(p == pytest.approx(score(c) - z(c), abs=1e-10) for c, p in got)
    else:
        strength = {"sn_objective": 0.1, "exact_objective": 0.0}[name]
        got = loglinear.self_normalized(pairs, contexts, vocab, strength).first()
        some = range(1, n + 1, 401)
        mean = np.mean([score(c) - z(c) - strength / 2 * z(c) ** 2 for c in some])
        assert got["n"] == 2 * n and got["objective"] / got["n"] == pytest.approx(mean, rel=2e-3)
    assert time.time() - began < 40


def test_draws_for_groups_are_not_shuffled(spark):
    """Groups of lines meet once; what is drawn for them and what is known of contexts and words comes to them."""
    plan = Q.QUERIES["noise_features"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(group_id" in plan


def test_model_of_texts_with_marks_rare_features_and_frequent_ones(spark, tmp_path, monkeypatch):
    """Marks as words, features beyond the broadcast ids, and a vocabulary that has the end mark."""
    text = "\n".join(f"a b{i % 40} <s> c </s> d{i % 7} a" + " e" * (i % 3) for i in range(250))
    spark.createDataFrame([(1, text), (2, "a\n\nb1"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for frequent in (4, 250_000):
        monkeypatch.setattr(counts, "FREQUENT", frequent)
        monkeypatch.setattr(counts.coded_pairs, "__kwdefaults__", {"frequent": frequent})
        for name in ("weight_dump", "gold_features", "noise_features"):
            assert oracle.compare(Q.QUERIES[name](spark, str(tmp_path)), con, Q.ORACLE_SQL[name]) is None, (name, frequent)


def test_training_on_all_groups_takes_them_all(spark, small):
    """More groups than a batch of the default has: the whole batch is the same however it is grouped."""
    _, contexts, vocab = small[:3]
    pairs = spark.range(600).select((F.col("id") % 2).alias("ctx"), (F.col("id") % 3).alias("word_id"), (1 + F.col("id") % 7).alias("n"), F.col("id").alias("group_id"))
    runs = [train.sgd(rows, contexts, vocab, train.Training(batch_groups=0, steps=3))[1] for rows in (pairs, pairs.withColumn("group_id", F.lit(0).cast("long")))]
    assert runs[0] == pytest.approx(runs[1], rel=1e-12) and runs[0][2] > runs[0][0]
