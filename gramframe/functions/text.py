"""Column expressions over arrays of words: n-grams, features, codes and hashes. All stay in generated code."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

Featurizer = Callable[[Column], Column]
_none = lambda: F.array().cast("array<string>")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value found once a row: what a lambda names is found anew for each of its elements, and the optimiser moves a column that is named once into it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(words: Column, k: int) -> Column:
    """All runs of k words as structs with the fields 0 to k - 1: shifted slices side by side, so that the cost is linear in the line."""
    runs = F.greatest(F.size(words) - (k - 1), F.lit(0))
    if k == 1:
        return F.transform(words, lambda w: F.struct(w.alias("0")))
    return F.arrays_zip(*[F.slice(words, F.lit(j + 1), runs) for j in range(k)])


def ngrams(words: Column, k: int, sep: str | None = " ") -> Column:
    """All runs of k words, joined by sep, or as arrays if sep is None."""
    parts = lambda z: [z[str(j)] for j in range(k)]
    return F.transform(windows(words, k), lambda z: F.array(*parts(z)) if sep is None else F.concat_ws(sep, *parts(z)))


def context(ngram: Column) -> Column:
    return F.slice(ngram, F.lit(1), F.size(ngram) - 1)


def last(ngram: Column) -> Column:
    return F.element_at(ngram, -1)


def middle(ngram: Column) -> Column:
    return F.slice(ngram, F.lit(2), F.greatest(F.size(ngram) - 2, F.lit(0)))


def ngram_features(least: int, most: int) -> Featurizer:
    """NGRAM__ and the i - 1 words before the predicted one, for each order i; short inputs give what they have."""

    def make(a: Column) -> Column:
        n = F.size(a)
        one = lambda i: F.concat(F.lit("NGRAM__"), F.array_join(F.slice(a, F.greatest(n - i, F.lit(0)) + 1, F.greatest(F.least(F.lit(i - 1), n - 1), F.lit(0))), "__"))
        return F.array(*[one(i) for i in range(least, most + 1)])

    return make


def skip_features(a: Column) -> Column:
    """SKIP__word_i of each word but the last two."""
    return F.when(F.size(a) > 2, F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - 2, F.lit(0))), lambda w, i: F.concat(F.lit("SKIP__"), w, F.lit("_"), i.cast("string")))).otherwise(_none())


def const_feature(a: Column) -> Column:
    return F.array(F.lit("CONST"))


def identity_feature(a: Column) -> Column:
    return F.array(last(a))


def union(*parts: Featurizer) -> Featurizer:
    """All features of all parts, repeats kept."""
    return lambda a: F.concat(*[f(a) for f in parts])


def cross(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of all pairs, the second array's elements running fastest."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: f(x, y))))


def product(f: Featurizer, g: Featurizer) -> Featurizer:
    """PROD(x,y) of all pairs."""
    return lambda a: cross(f(a), g(a), lambda x, y: F.concat(F.lit("PROD("), x, F.lit(","), y, F.lit(")")))


def scaled_add(a: Column, scale: Column | float, b: Column) -> Column:
    """a + scale * b of two arrays of numbers."""
    s = F.lit(scale) if isinstance(scale, (int, float)) else scale
    return F.zip_with(a, b, lambda x, y: x + s * y)


def filled(rows: int, columns: int, value: Column) -> Column:
    """A matrix of one value."""
    return F.array_repeat(F.array_repeat(value, columns), rows)


def distinct(f: Featurizer) -> Featurizer:
    """Each feature once."""
    return lambda a: F.array_distinct(f(a))


def identity(word: Column) -> Column:
    """The preprocessor that changes nothing."""
    return word


def before(word: Callable[[Column], Column], f: Featurizer) -> Featurizer:
    """f of the words as `word` changes them."""
    return lambda a: f(F.transform(a, word))


def suffixes(word: Column) -> Column:
    """All suffixes, from the word itself to the empty one."""
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(word, i, F.length(word)))


def code_suffixes(code: Column) -> Column:
    """The suffixes of a code that are not empty."""
    return F.when(F.length(code) > 0, F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.substring(code, i, F.length(code)))).otherwise(_none())


def bit_sign(bit: Column) -> Column:
    return F.when(bit == "1", 1).otherwise(-1)


def pack_ids(*ids: Column, bits: int = 20, carry: bool = False) -> Column:
    """Up to three word ids of 20 bits after a bit that is set; a missing id leaves its place empty. An id beyond its bits is an error, as
    its key would be another's. With carry they are added up, and only a sum beyond a long is an error: keys are then not unique."""
    key = F.lit(1).cast("long")
    for i, c in enumerate(ids):
        low = 1 + bits * i
        most = 1 << (63 - low if carry else bits)
        whole = F.when(c.cast("long") >= most, F.raise_error(F.concat(F.lit("an id is over the bits of its place: "), c.cast("string")))).otherwise(F.shiftleft(c.cast("long"), low))
        part = F.coalesce(whole, F.lit(0).cast("long"))
        key = key + (F.when(key > F.lit((1 << 63) - 1) - part, F.raise_error(F.lit("the key is over 63 bits"))).otherwise(part) if carry else part)
    return key


def pack_ids_wide(*ids: Column, bits: int = 20) -> Column:
    """The sum that pack_ids makes with carry, as a decimal(38,0), which has room for up to three ids whatever their size. Sums that are
    surely within a long are made as longs."""
    wide, lows = "decimal(38,0)", [1 + bits * i for i in range(len(ids))]
    long = [F.coalesce(c.cast("long"), F.lit(0).cast("long")) for c in ids]
    small, short, whole = F.lit(True), F.lit(1).cast("long"), F.lit(Decimal(1))
    for low, c in zip(lows, long):
        small = small & (c < 1 << 61 - low)
        short = short + F.shiftleft(c, low)
        whole = whole + c.cast("decimal(19,0)") * F.lit(Decimal(1 << low))
    return F.when(small, short.cast(wide)).otherwise(whole.cast(wide))


def left_context(words: Column, size: int, start: str) -> Column:
    """For each place the `size` words before it, the nearest first, filled with the start symbol."""
    filled_words = F.concat(F.array_repeat(F.lit(start), size), words)
    return F.transform(windows(filled_words, size + 1), lambda z: F.array(*[z[str(size - 1 - o)] for o in range(size)]))


def known_ids(ids: Column) -> Column:
    """Ids without the -1 of unknown words."""
    return F.filter(ids, lambda x: x != -1)


def joined_ids(ids: Column) -> Column:
    """A sequence of ids as text."""
    return F.array_join(ids.cast("array<string>"), "_")


def sequence_hash(ids: Column, primes: tuple[int, ...] = (2, 3, 5, 7)) -> Column:
    """The sum of each id and the prime of its place."""
    table = F.array(*[F.lit(p) for p in primes])
    return F.aggregate(F.transform(ids, lambda x, i: (x + F.element_at(table, (i % len(primes)) + 1)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def pair_hash(first: Column, second: Column) -> Column:
    return first + 7 * second


def product_id(first: Column, second: Column, buckets: int, base: Column | int = 0) -> Column:
    """base plus the bucket of a pair of ids that are not negative."""
    return base + F.pmod(first.cast("long") * 73856093 + second.cast("long") * 19349663, F.lit(buckets).cast("long"))


def product_name(first: Column, second: Column) -> Column:
    return F.concat(F.lit("CrossProductIndex("), first, F.lit("::::"), second, F.lit(")"))


def hash_name(bucket: Column) -> Column:
    return F.concat(F.lit("Hash("), bucket.cast("string"), F.lit(")"))


def parse_product_name(name: Column) -> tuple[Column, Column]:
    return F.regexp_extract(name, r"^CrossProductIndex\((.*)::::(.*)\)$", 1), F.regexp_extract(name, r"^CrossProductIndex\((.*)::::(.*)\)$", 2)


def parse_hash_name(name: Column) -> Column:
    """The bucket, null for other names."""
    return F.nullif(F.regexp_extract(name, r"^Hash\((\d+)\)$", 1), F.lit("")).cast("long")


def bucket_count(ratio: float, pairs: int) -> int:
    """How many hash buckets stand beside an index of pairs."""
    return int(ratio * pairs)


def region_id(known_id: Column, feature_hash: Column, positive: int, negative: int) -> Column:
    """Known features by their id in a first region, unknown ones by hash in a second."""
    return F.when(known_id.isNotNull(), F.pmod(known_id.cast("long"), F.lit(positive))).otherwise(positive + F.pmod(feature_hash, F.lit(negative)))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) that does not overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_ln(p: Column) -> Column:
    """Null where there is no logarithm."""
    return F.when(p > 0, F.ln(p))
