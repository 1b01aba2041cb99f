"""More queries of the n-gram engine: projections, indexes, sampling, gradients and the combined model. Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramframe.functions import text as X
from gramframe.operators import counts as N
from gramframe.operators import loglinear, smoothing, train
from gramframe.plans import queries as Q
from gramframe.plans.queries import BASE, FEATS, HEAD, HELD, H4, M31, MIN_WORD, NOISE, NOISY, SM, SOFT, SP, SUFFIX, TH, TRI, TRI_SCORE, VOCAB, _context_model, _feature_ids, _feature_rows, _grams, _typed, corpus, exploded, held_out, query, rounded
from gramframe.sources import corpus as C
from gramframe.sources.stage import cut, sized

LONG = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


@query(f"{H4} {HEAD} 'CONST' AS features FROM h4")
def const_features(spark, sf_dir):
    return _feature_rows(spark, sf_dir, X.const_feature)


@query(f"{H4} {HEAD} CASE WHEN w2 = w3 THEN 'NGRAM__' || w3 ELSE 'NGRAM__' || w3 || ' NGRAM__' || w2 END || ' CONST' AS features FROM h4")
def distinct_features(spark, sf_dir):
    """Each feature of a row once: the previous words as features of their own, and a constant that two featurisers give."""
    previous = lambda a: F.array(F.concat(F.lit("NGRAM__"), F.element_at(a, -2)), F.concat(F.lit("NGRAM__"), F.element_at(a, -3)))
    return _feature_rows(spark, sf_dir, X.distinct(X.union(previous, X.const_feature, X.const_feature)))


@query(f"{H4} {HEAD} 'NGRAM__' || substring(w3, 1, 3) || ' CONST' AS features FROM h4")
def preprocessed_features(spark, sf_dir):
    """Words are cut to three characters before one featuriser, and left as they are before the other."""
    return _feature_rows(spark, sf_dir, X.union(X.before(lambda w: F.substring(w, 1, 3), X.ngram_features(2, 2)), X.before(X.identity, X.const_feature)))


@query(f"{BASE} SELECT doc_id, line_no, i - 1 AS pos, CASE WHEN i > 1 THEN words[i - 1] ELSE '<s>' END || ' ' || CASE WHEN i > 2 THEN words[i - 2] ELSE '<s>' END AS context FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM t)")
def left_contexts(spark, sf_dir):
    """The two words before each, the nearest first, filled with the start symbol."""
    rows = corpus(spark, sf_dir).select("doc_id", "line_no", "words", F.posexplode(X.left_context(F.col("words"), 2, C.START)).alias("pos", "context"))
    # a window of size + 1 ends at the word itself, so there are as many as there are words
    return rows.select("doc_id", *LONG("line_no", "pos"), F.array_join("context", " ").alias("context"))


@query(f"{BASE}, {_grams(3)}, {_typed(3)} SELECT w1 || ' ' || w2 AS context, w3 AS last, w1 AS head, w2 || ' ' || w3 AS tail, w2 AS middle, c FROM n3")
def ngram_parts(spark, sf_dir):
    types = N.word_columns(corpus(spark, sf_dir), 3).select(F.array("w1", "w2", "w3").alias("g"), "c")
    return types.select(F.array_join(X.context(F.col("g")), " ").alias("context"), X.last(F.col("g")).alias("last"), F.element_at("g", 1).alias("head"), F.array_join(F.slice("g", 2, 2), " ").alias("tail"), F.array_join(X.middle(F.col("g")), " ").alias("middle"), "c")


@query(f"WITH {Q._lines()} SELECT doc_id, line_no, array_to_string(string_split(trim(line, ' '), ' '), '|') AS words FROM l WHERE trim(line, ' ') <> ''")
def trimmed_tokens(spark, sf_dir):
    """Lines without spaces at either end, split at each space, inner empty words kept."""
    rows = C.tokenized(Q.table(spark, sf_dir).select("doc_id", "text"), trim=True, strict=True)
    return rows.select("doc_id", *LONG("line_no"), F.array_join("words", "|").alias("words"))


@query(f"{BASE}, em AS (SELECT doc_id, line_no, list_concat(words, ['</s>']) AS w FROM t), {_grams(2, 'em', 'e2')} SELECT w1, w2, count(*) AS c FROM e2 GROUP BY ALL")
def end_marked_bigrams(spark, sf_dir):
    """Bigrams of lines with the end mark alone."""
    g = corpus(spark, sf_dir).select(F.inline(X.windows(C.end_marked(F.col("words")), 2)).alias("w1", "w2"))
    return g.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"))


@query(f"{BASE}, {_grams(2, 't2', 'b2').replace('FROM t2', 'FROM (SELECT doc_id, line_no, words AS w FROM t)')} SELECT CAST(1 AS BIGINT) AS n, word AS ngram, count(*) AS c FROM (SELECT unnest(words) AS word FROM t) GROUP BY ALL UNION ALL SELECT 2, w1 || ' ' || w2, count(*) FROM b2 GROUP BY ALL")
def ngram_counts_unpadded(spark, sf_dir):
    return N.ngram_counts(corpus(spark, sf_dir), (1, 2), pad=False).withColumn("n", F.col("n").cast("long"))


BATCH = f"gs AS (SELECT DISTINCT (i * 1103515245 + 12345) % {M31} % (SELECT max(ordinal // 100) + 1 FROM o) AS group_id FROM range(8) r(i))"


@query(f"{BASE}, {Q.ORDINAL}, {BATCH} SELECT doc_id, line_no, ordinal // 100 AS group_id FROM o JOIN gs ON group_id = ordinal // 100")
def minibatch_lines(spark, sf_dir):
    """The lines of one training batch: eight groups drawn by an arithmetic rule."""
    groups = C.line_groups(corpus(spark, sf_dir), 100)
    n = (groups.agg(F.max("group_id")).first()[0] or 0) + 1
    return C.in_groups(groups, [(i * 1103515245 + 12345) % M31 % n for i in range(8)]).select("doc_id", *LONG("line_no", "group_id"))


@query(f"{BASE}, {VOCAB}, ids AS (SELECT doc_id, line_no, list(word_id ORDER BY i) AS ids FROM (SELECT doc_id, line_no, i, words[i] AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM t)) JOIN v USING (word) GROUP BY ALL) SELECT doc_id, line_no, array_to_string(ids, '_') AS ids, CAST(list_sum(list_transform(ids, lambda x, i : x + [2, 3, 5, 7][(i - 1) % 4 + 1])) AS BIGINT) AS hash, CAST(list_sum(list_transform(ids, lambda x, i : x + [2, 3, 5, 7][(i - 1) % 4 + 1])) + 7 * ids[len(ids)] AS BIGINT) AS pair_hash FROM ids")
def known_word_ids(spark, sf_dir):
    """Each line's ids of vocabulary words, with those of other words (-1) dropped; hashes of the sequence, and of it and its last id."""
    rows = corpus(spark, sf_dir)
    words = rows.select("doc_id", "line_no", F.posexplode("words").alias("at", "word")).join(sized(cut(Q.vocabulary(rows).select("word", "word_id"), "vocabulary")), "word", "left")
    line = words.groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("word_id", F.lit(-1).cast("long")).alias("id")))).alias("line"))
    ids = line.select("doc_id", "line_no", X.known_ids(F.col("line.id")).alias("ids")).where(F.size("ids") > 0)
    return ids.select("doc_id", *LONG("line_no"), X.joined_ids(F.col("ids")).alias("ids"), X.sequence_hash(F.col("ids")).alias("hash"), X.pair_hash(X.sequence_hash(F.col("ids")), F.element_at("ids", -1)).alias("pair_hash"))


PRODUCT = """x AS (SELECT DISTINCT word_id, fid FROM (SELECT w2, unnest(['CONST', 'NGRAM__' || w1]) AS feature FROM n2) e JOIN v ON v.word = w2 JOIN f ON f.feature = e.feature),
px AS (SELECT word_id, fid, row_number() OVER (ORDER BY word_id, fid) - 1 AS pid FROM x), pn AS (SELECT count(*) AS pairs FROM px),
hb AS (SELECT DISTINCT w2 AS w1, w3 AS w2 FROM h3), hq AS (SELECT DISTINCT word_id, v.word, f.fid, f.feature FROM (SELECT w2, unnest(['CONST', 'NGRAM__' || w1]) AS feature FROM hb) e JOIN v ON v.word = w2 JOIN f ON f.feature = e.feature)"""


@query(f"{BASE}, {VOCAB}, {FEATS}, {HELD}, {PRODUCT} SELECT word_id, fid, coalesce(pid, pairs + (word_id * 73856093 + fid * 19349663) % pairs) AS id, CASE WHEN pid IS NULL THEN 'Hash(' || CAST((word_id * 73856093 + fid * 19349663) % pairs AS VARCHAR) || ')' ELSE 'CrossProductIndex(' || word || '::::' || feature || ')' END AS name FROM hq LEFT JOIN px USING (word_id, fid), pn")
def product_fallback_index(spark, sf_dir):
    """Ids of held-out (word, feature) pairs: those of the corpus by its index, others by hash in as many buckets behind it."""
    pairs, contexts, vocab, feats = _context_model(corpus(spark, sf_dir))
    index = cut(N.dense_ids(pairs.join(contexts, "ctx").select("word_id", "fid").distinct(), "word_id", F.col("word_id"), F.col("fid"), name="pid"), "index")
    size = index.count()
    buckets = X.bucket_count(1.0, size)
    g = exploded(held_out(spark, sf_dir), 3).select(F.concat(F.lit("NGRAM__"), "w2").alias("own"), F.col("w3").alias("word")).distinct()
    asked = g.select("word", F.explode(F.array(F.lit("CONST"), "own")).alias("feature")).distinct().join(vocab.select("word", "word_id"), "word").join(feats.select("feature", "fid"), "feature")
    bucket = X.product_id(F.col("word_id"), F.col("fid"), max(buckets, 1))
    name = F.when(F.col("pid").isNull(), X.hash_name(bucket)).otherwise(X.product_name(F.col("word"), F.col("feature")))
    return asked.join(index, ["word_id", "fid"], "left").select("word_id", "fid", F.coalesce("pid", F.lit(size) + bucket).alias("id"), name.alias("name"))


@query(f"{BASE}, {VOCAB}, {FEATS}, {HELD}, {PRODUCT}, nm AS (SELECT pid, 'CrossProductIndex(' || word || '::::' || feature || ')' AS name FROM px JOIN v USING (word_id) JOIN f USING (fid)) SELECT name, regexp_extract(name, '^CrossProductIndex\\((.*)::::(.*)\\)$', 1) AS word, regexp_extract(name, '^CrossProductIndex\\((.*)::::(.*)\\)$', 2) AS feature, pid FROM nm")
def product_names(spark, sf_dir):
    """Names of indexed pairs, and what they parse back to."""
    pairs, contexts, vocab, feats = _context_model(corpus(spark, sf_dir))
    index = N.dense_ids(pairs.join(contexts, "ctx").select("word_id", "fid").distinct(), "word_id", F.col("word_id"), F.col("fid"), name="pid")
    named = index.join(vocab.select("word", "word_id"), "word_id").join(feats.select("feature", "fid"), "fid").select(X.product_name(F.col("word"), F.col("feature")).alias("name"), "pid")
    word, feature = X.parse_product_name(F.col("name"))
    return named.select("name", word.alias("word"), feature.alias("feature"), "pid")


@query(f"{BASE}, {FEATS} SELECT fc.feature, CASE WHEN fid IS NOT NULL THEN fid % 4096 ELSE 4096 + CAST('0x' || substring(md5(fc.feature), 1, 7) AS BIGINT) % 1024 END AS id FROM fc LEFT JOIN f USING (feature)")
def region_index(spark, sf_dir):
    """Indexed features in a first region of 4096 places, all others by their digest in a second of 1024."""
    grams = cut(Q._bigrams(corpus(spark, sf_dir)), "bigrams")
    counts = Q._feature_counts(None, grams)
    known = _feature_ids(None, grams).select("feature", "fid")
    digest = F.conv(F.substring(F.md5("feature"), 1, 7), 16, 10).cast("long")
    return counts.join(known, "feature", "left").select("feature", X.region_id(F.col("fid"), digest, 4096, 1024).alias("id"))


@query(f"{BASE}, rc AS (SELECT word, count(*) AS c FROM (SELECT unnest(words) AS word FROM t) GROUP BY word), mp AS (SELECT CASE WHEN c <= 2 THEN 'UNK' ELSE word END AS word, CAST(sum(c) AS BIGINT) AS c FROM rc GROUP BY ALL) SELECT word, c, row_number() OVER (ORDER BY c DESC, word) - 1 AS id FROM mp")
def collapsed_index(spark, sf_dir):
    """The index once rare words are one."""
    counts = cut(N.unigrams(corpus(spark, sf_dir)), "unigrams")
    mapped = counts.select(F.when(F.col("c") > 2, F.col("word")).otherwise(C.UNK).alias("word"), "c").groupBy("word").agg(F.sum("c").cast("long").alias("c"))
    return N.dense_ids(mapped, "word", F.desc("c"), F.col("word"), name="id")


@query(f"{BASE}, {VOCAB}, {SUFFIX}, mw AS (SELECT v.word, coalesce(max_by(x.suffix, length(x.suffix)), 'UNK') AS mapped FROM v LEFT JOIN (SELECT x.* FROM x JOIN sx USING (suffix) WHERE types >= 3) x ON x.word = v.word GROUP BY v.word), mi AS (SELECT mapped, row_number() OVER (ORDER BY mapped) - 1 AS id FROM (SELECT DISTINCT mapped FROM mw)) SELECT word, id FROM mw JOIN mi USING (mapped)")
def preprocessed_lookup(spark, sf_dir):
    """Ids of words by an index of their frequent suffixes."""
    vocab = cut(N.vocab_cut(N.unigrams(corpus(spark, sf_dir)), MIN_WORD), "vocabulary")
    mapped = cut(N.suffix_backoff(vocab, N.suffix_counts(vocab), 3), "mapped")
    index = N.dense_ids(mapped.select("mapped").distinct(), "mapped", name="id")
    return mapped.join(index, "mapped").select("word", "id")


SN = f"""cf AS (SELECT fid FROM f WHERE feature = 'CONST'),
sn AS (SELECT h3.*, CASE WHEN v.word_id IS NOT NULL THEN {TH('v.word_id * 73856093 + cf.fid * 19349663')} + coalesce({TH('v.word_id * 73856093 + f.fid * 19349663')}, 0) END AS score FROM h3 LEFT JOIN v ON v.word = h3.w3 LEFT JOIN f ON f.feature = 'NGRAM__' || h3.w2, cf)"""


def _sn_scored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Held-out trigrams with the score of the unnormalised model, null for words beyond its vocabulary."""
    grams = cut(Q._bigrams(corpus(spark, sf_dir)), "bigrams")
    words = grams.where(F.col("w2") != C.STOP).groupBy(F.col("w2").alias("word")).agg(F.sum("c").alias("c"))
    vocab = N.dense_ids(N.vocab_cut(words, MIN_WORD), "word", F.desc("c"), F.col("word"), name="word_id")
    feats = _feature_ids(None, grams)
    h = cut(exploded(held_out(spark, sf_dir), 3), "held_out")
    asked = Q.contexts_of(h.withColumn("own", F.concat(F.lit("NGRAM__"), "w2")), feats).join(vocab.select(F.col("word").alias("w3"), "word_id"), "w3", "left")
    contexts = Q._feature_bags(asked.select("ctx").distinct(), feats)
    pairs = cut(asked.where("word_id is not null").select("ctx", "word_id").distinct(), "asked")
    weights = pairs.join(contexts, "ctx").select(loglinear.pid_of().alias("pid")).distinct().withColumn("weight", loglinear.theta_of(F.col("pid")))
    scored = train.unnormalized_scores(pairs, contexts, weights)
    return h, asked.join(scored, ["ctx", "word_id"], "left").select("doc_id", "line_no", "pos", "w1", "w2", "w3", "score")


@query(f"{BASE}, {VOCAB}, {FEATS}, {HELD}, {SN} SELECT doc_id, line_no, CAST(pos AS BIGINT) AS pos, round(score, 6) AS score FROM sn")
def sn_score(spark, sf_dir):
    """Scores without the partition function, of words that the model knows."""
    return _sn_scored(spark, sf_dir)[1].select("doc_id", *LONG("line_no", "pos"), rounded("score").alias("score"))


@query(f"{BASE}, {VOCAB}, {FEATS.replace(_grams(2) + ', ' + _typed(2) + ', ', '')}, {TRI}, {HELD}, {SN}, {TRI_SCORE} SELECT sn.doc_id, sn.line_no, CAST(sn.pos AS BIGINT) AS pos, round(coalesce(sn.score, CASE WHEN s.p > 0 THEN ln(s.p) END), 6) AS log_prob FROM sn JOIN s USING (doc_id, line_no, pos)".replace(f"{VOCAB}, fc AS", f"{VOCAB}, {_grams(2)}, {_typed(2)}, fc AS").replace(f", {TRI}", ", " + TRI.removeprefix(f"{_grams(2)}, {_typed(2)}, ").replace(f"{_grams(2)}, {_typed(2)}, ", "")))
def combined_lm(spark, sf_dir):
    """The unnormalised model's score, the interpolated trigram's where it has none."""
    key = F.struct("doc_id", "line_no", "pos").alias("key")
    h, scored = _sn_scored(spark, sf_dir)
    trigram = smoothing.trigram_score(h.withColumnsRenamed({"w1": "u", "w2": "v", "w3": "w"}), smoothing.trigram_model(corpus(spark, sf_dir)))
    out = smoothing.fallback(scored.select(key, F.col("score").alias("log_prob")), trigram.select(key, "log_prob"), "key")
    return out.select("key.doc_id", F.col("key.line_no").cast("long").alias("line_no"), F.col("key.pos").cast("long").alias("pos"), rounded("log_prob").alias("log_prob"))


@query(f"{BASE}, {_grams(3)}, {_typed(3)}, {HELD} SELECT h3.doc_id, h3.line_no, CAST(pos AS BIGINT) AS pos, coalesce(c, 0) AS c FROM h3 LEFT JOIN n3 USING (w1, w2, w3)")
def count_lookup(spark, sf_dir):
    names = ["w1", "w2", "w3"]
    h = cut(exploded(held_out(spark, sf_dir), 3), "held_out")
    counts = smoothing.asked_of(h)(N.word_columns(corpus(spark, sf_dir), 3), **{n: n for n in names})
    return smoothing.get_count(h, counts, names).select("doc_id", *LONG("line_no", "pos"), "c")


@query(f"{SM} SELECT round(sum(n * (score - logz)), 3) AS objective FROM p JOIN a USING (ctx, word_id) JOIN z USING (ctx)")
def exact_objective(spark, sf_dir):
    return loglinear.self_normalized(*_context_model(corpus(spark, sf_dir))[:3], 0.0).select(rounded("objective", 3).alias("objective"))


LOGIT = f"score - ln({NOISE}) - ln(q)"
SIGMA = lambda x: f"1 / (1 + exp(-({x})))"
PID = "(word_id * 73856093 + fid * 19349663) % 1048576"


@query(f"{SM}, {NOISY}, wt AS (SELECT p.ctx, p.word_id, n * (1 - {SIGMA(LOGIT)}) AS w FROM p JOIN a USING (ctx, word_id) JOIN q USING (word_id) UNION ALL SELECT noise.ctx, noise_id, -n * {SIGMA(LOGIT)} FROM noise JOIN p USING (ctx, word_id) JOIN a ON a.ctx = noise.ctx AND a.word_id = noise_id JOIN q ON q.word_id = noise_id) SELECT {PID} AS pid, round(sum(w), 5) AS g FROM wt JOIN k USING (ctx) GROUP BY ALL")
def nce_gradient(spark, sf_dir):
    pairs, contexts, vocab, _ = _context_model(corpus(spark, sf_dir))
    noise, q = Q.noise_of(pairs, vocab)
    return loglinear.nce_gradient(pairs, noise, contexts, q, NOISE).select("pid", rounded("g", 5).alias("g"))


CANDIDATES = "cn AS (SELECT ctx, word_id AS o, word_id, n, 1 AS own FROM p UNION ALL SELECT noise.ctx, noise.word_id, noise_id, n, 0 FROM noise JOIN p USING (ctx, word_id))"
SAMPLED_W = "zs AS (SELECT ctx, o, sum(exp(score)) AS z FROM cs GROUP BY ALL), wt AS (SELECT cs.*, n * (own - exp(score) / z) AS w FROM cs JOIN zs USING (ctx, o))"


@query(f"{SM}, {NOISY}, {CANDIDATES}, cs AS (SELECT cn.*, score FROM cn JOIN a USING (ctx, word_id)), {SAMPLED_W} SELECT {PID} AS pid, round(sum(w), 5) AS g FROM wt JOIN k USING (ctx) GROUP BY ALL")
def sampled_softmax_gradient(spark, sf_dir):
    pairs, contexts, vocab, _ = _context_model(corpus(spark, sf_dir))
    return loglinear.sampled_softmax_gradient(pairs, Q.noise_of(pairs, vocab)[0], contexts).select("pid", rounded("g", 5).alias("g"))


RANK = 4
LOW = f"""lx AS (SELECT cn.ctx, o, cn.word_id, n, own, d, sum(CAST((({PID.replace('word_id', 'cn.word_id')} * {RANK} + d) * 37) % 101 - 50 AS DOUBLE) / 500) AS x FROM (SELECT *, row_number() OVER () AS rid FROM cn) cn JOIN k USING (ctx), range({RANK}) r(d) GROUP BY cn.ctx, o, cn.word_id, n, own, d, rid),
lv AS (SELECT DISTINCT ctx, word_id, d, x FROM (SELECT ctx, word_id, d, round(x, 9) AS x FROM lx)), ls AS (SELECT ctx, word_id, sum(x * x) AS score FROM lv GROUP BY ALL), cs AS (SELECT cn.*, score FROM cn JOIN ls USING (ctx, word_id))"""


@query(f"{SM}, {NOISY}, {CANDIDATES}, {LOW} SELECT round(sum(n * (own_score - ln(z))), 3) AS objective FROM (SELECT ctx, o, max(n) AS n, max(score) FILTER (own = 1) AS own_score, sum(exp(score)) AS z FROM cs GROUP BY ALL)")
def lowrank_objective(spark, sf_dir):
    pairs, contexts, vocab, _ = _context_model(corpus(spark, sf_dir))
    return loglinear.low_rank(pairs, Q.noise_of(pairs, vocab)[0], contexts, RANK).select(rounded("objective", 3).alias("objective"))


@query(f"{SM}, {NOISY}, {CANDIDATES}, {LOW}, {SAMPLED_W}, wl AS (SELECT ctx, word_id, sum(w) AS w FROM wt GROUP BY ALL) SELECT {PID} * {RANK} + d AS pid, round(sum(2 * w * x), 5) AS g FROM wl JOIN lv USING (ctx, word_id) JOIN k USING (ctx) GROUP BY ALL")
def lowrank_gradient(spark, sf_dir):
    pairs, contexts, vocab, _ = _context_model(corpus(spark, sf_dir))
    return loglinear.low_rank_gradient(pairs, Q.noise_of(pairs, vocab)[0], contexts, RANK).select("pid", rounded("g", 5).alias("g"))


@query(f"{SM}, un AS (SELECT ctx, word_id, j, {Q.DRAW} % (SELECT count(*) FROM v) AS noise_id FROM p, range({NOISE}) r(j)) SELECT ctx, word_id, j, noise_id FROM un")
def uniform_noise_samples(spark, sf_dir):
    pairs, _, vocab, _ = _context_model(corpus(spark, sf_dir))
    return Q.uniform_noise(pairs, vocab)[0]


@query(f"{BASE}, {VOCAB}, {FEATS}, {HELD}, {PRODUCT} SELECT pairs AS sparse, {RANK} * pairs AS low_rank FROM pn")
def num_params(spark, sf_dir):
    pairs, contexts, _, _ = _context_model(corpus(spark, sf_dir))
    n = pairs.join(contexts, "ctx").select("word_id", "fid").distinct().agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("n").alias("sparse"), (F.col("n") * RANK).alias("low_rank"))


GROUPED = f"{Q.ORDINAL}, og AS (SELECT ordinal // 100 AS group_id, list_concat(['<s>'], words, ['</s>']) AS w FROM o), gg AS (SELECT group_id, coalesce(f.fid, -1) AS ctx, word_id, count(*) AS n FROM (SELECT group_id, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT *, unnest(range(1, len(w))) AS i FROM og)) JOIN v ON v.word = w2 LEFT JOIN f ON f.feature = 'NGRAM__' || w1 GROUP BY ALL)"


def _materialised(rows: DataFrame, feats: DataFrame, q: DataFrame) -> DataFrame:
    """rows (group_id, ctx, word_id, n) with the parameter ids of each and the logarithm of its noise probability; no row is shuffled."""
    pids = F.sort_array(F.transform("fids", lambda f: X.product_id(F.col("word_id"), f, loglinear.BUCKETS)))
    return Q.with_bags(rows, feats).join(sized(q), "word_id").select("group_id", "ctx", "word_id", "n", X.joined_ids(pids).alias("pids"), rounded(F.ln("q")).alias("log_q"))


@query(f"{SM}, {NOISY}, {GROUPED} SELECT group_id, ctx, word_id, n, array_to_string(list({PID} ORDER BY {PID}), '_') AS pids, round(ln(max(q)), 6) AS log_q FROM gg JOIN k USING (ctx) JOIN q USING (word_id) GROUP BY group_id, ctx, word_id, n")
def gold_features(spark, sf_dir):
    """Of each group of lines: what follows what, how often, its parameters and noise probability. C.save_groups writes such rows, a folder a group."""
    rows, vocab, feats = Q.grouped_pairs(corpus(spark, sf_dir))
    return _materialised(rows, feats, Q.noise_of(rows, vocab)[1])


@query(f"{SM}, {NOISY}, {GROUPED}, gn AS (SELECT group_id, gg.ctx, noise_id AS word_id, CAST(sum(n) AS BIGINT) AS n FROM gg JOIN (SELECT DISTINCT ctx, word_id, j, noise_id FROM noise) USING (ctx, word_id) GROUP BY ALL) SELECT group_id, ctx, word_id, n, array_to_string(list({PID} ORDER BY {PID}), '_') AS pids, round(ln(max(q)), 6) AS log_q FROM gn JOIN k USING (ctx) JOIN q USING (word_id) GROUP BY group_id, ctx, word_id, n")
def noise_features(spark, sf_dir):
    """The same of the words drawn as noise. Groups are together before they are drawn for, so the draws stay where they are."""
    rows, vocab, feats = Q.grouped_pairs(corpus(spark, sf_dir))
    noise, q = Q.noise_of(rows, vocab, keep=("group_id", "n"))
    drawn = noise.groupBy("group_id", "ctx", F.col("noise_id").alias("word_id")).agg(F.sum("n").alias("n"))
    return _materialised(drawn, feats, q)


@query(f"{Q.ORACLE_SQL['feature_covariance'].replace(' SELECT b.f, b.g, round(', ', cov AS (SELECT b.f, b.g, round(')}) SELECT place, f, g, cov FROM (SELECT *, row_number() OVER (ORDER BY cov DESC, f, g) - 1 AS place FROM cov) WHERE place % 100 = 0")
def covariance_profile(spark, sf_dir):
    """Every hundredth covariance from the largest down, which is the operator's own rule."""
    ranked = N.dense_ids(Q.feature_covariance(spark, sf_dir), "cov", F.desc("cov"), F.col("f"), F.col("g"), name="place")
    return ranked.where("place % 100 = 0").select("place", "f", "g", "cov")


QUERIES, ORACLE_SQL, entry = Q.QUERIES, Q.ORACLE_SQL, Q.entry
