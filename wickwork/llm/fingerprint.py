"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions alone.

A paragraph is a line that is not empty. Its vector has ``WIDE`` numbers modulo 2**32, hashed from the whole paragraph, and, so that alike paragraphs have
alike vectors, the sum of the vectors of its stretches (``STRETCH`` words at most, ended early by a full stop, question or exclamation mark): a one, and
``2 * SEEDS * BITS`` bits hashed from the stretch, counted modulo 2**30. A text's fingerprint is the sum of its paragraphs' vectors, so it does not
depend on their order; ``plus`` and ``minus`` insert and delete paragraphs without reading the rest. Two counts share a number, with a guard bit each,
so that one addition and one mask add both.

Equal fingerprints mean equal multisets of paragraphs, up to collisions of hashes (256 bits from paragraphs, 174 from stretches, not cryptographic).
``likeness`` reads counts as sums of signs, whose scalar products estimate how many stretches two texts have in common:
twice the product over the sum of both squared lengths (standard error about 0.08), 1 for equal fingerprints, 0 at least.

Vectors are sums over exploded stretches, combined in each task. The edited text's fingerprint comes from the text's own: the paragraphs from the cut on are deleted, the new ones
inserted. The next document in the order of ids is found on a narrow table (range-partitioned, one row per range for the seams); texts are shuffled once, by a digest of id
and text, and each document's opening goes to the document before.

Defined results: a null text counts as empty, the fingerprint of a text without any paragraph is that of the empty text, and two empty ones have the likeness 1; null ids
come after all others; rows of one id are ordered by the digest of id and text, and the next document of a repeated row is its copy, except for the last; a single row is followed by
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.common import written

WIDE, STRETCH, SEEDS, BITS = 8, 8, 3, 29
#: Two counts of 30 bits in a number, with a guard bit each: their places, one count, both, the guards.
ONES, SLOT = 1 | 1 << 31, (1 << 30) - 1
COUNTS, GUARDS, MOD = SLOT | SLOT << 31, ONES << 30, (1 << 32) - 1
#: Numbers of a fingerprint: the stretches, the paragraph hashes, the counts.
NUMBERS = 1 + WIDE + SEEDS * BITS
#: Rows of a repeated row that one task writes.
COPIES = 4096
_STRETCHES = rf"(?:[^ ]*[^ .!?] +){{0,{STRETCH - 1}}}[^ ]+"


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def summed(rows: DataFrame, keys: list[str], parts: Column) -> DataFrame:
    """Per ``keys``, which name single rows, the signed sum of the vectors of ``parts``, an array of (sign, p): ``w_sum``, NUMBERS plain integers.

    A text has less than 2**30 stretches, so no sum overflows before it is masked.
    """
    each = rows.select(*keys, F.explode_outer(parts).alias("w_part"))
    each = each.select(*keys, "w_part.sign", "w_part.p", F.posexplode_outer(F.regexp_extract_all("w_part.p", F.lit(_STRETCHES), F.lit(0))).alias("w_at", "w_unit"))
    hashed = [f"xxhash64(w_unit, {s}) AS w_h{s}" for s in range(SEEDS)]
    each = each.selectExpr(*keys, "bigint(sign) AS w_sign", "p", "bigint(if(w_unit IS NULL, NULL, sign)) AS w_one", "coalesce(w_at, 0) = 0 AS w_first", *hashed)
    wide = [f"sum(if(w_first, w_sign * (xxhash64(p, {k}) & {MOD}L), 0L))" for k in range(WIDE)]
    counts = [f"sum(w_one * (shiftrightunsigned(w_h{s}, {t}) & {ONES}L))" for s in range(SEEDS) for t in range(BITS)]
    got = each.groupBy(*keys).agg(*[F.expr(f"{c} AS w_s{k}") for k, c in enumerate(["sum(w_one)", *wide, *counts])])
    return got.selectExpr(*keys, f"array({', '.join(f'coalesce(w_s{k}, 0L)' for k in range(NUMBERS))}) AS w_sum")


def signed(parts: Column, sign: int) -> Column:
    return F.transform(parts, lambda p: F.struct(F.lit(sign).alias("sign"), p.alias("p")))


def _array(*numbers: int) -> str:
    return f"array({', '.join(f'{n}L' for n in numbers)})"


#: Of each number of a fingerprint its modulus less one, and its guards.
MASKS = _array(SLOT, *[MOD] * WIDE, *[COUNTS] * (SEEDS * BITS))
GUARDED = _array(*[0] * (1 + WIDE), *[GUARDS] * (SEEDS * BITS))


def plus(a: str, b: str) -> Column:
    """The fingerprint of both multisets (columns ``a`` and ``b``) together; ``b`` may be a signed sum, if no count falls below zero."""
    return F.expr(f"transform({a}, (x, k) -> (x + get({b}, k)) & get({MASKS}, k))")


def minus(a: str, b: str) -> Column:
    """The fingerprint of what is left of ``a`` without ``b``."""
    return F.expr(f"transform({a}, (x, k) -> ((x | get({GUARDED}, k)) - get({b}, k)) & get({MASKS}, k))")


def _counts(v: str) -> str:
    return f"slice({v}, {2 + WIDE}, {SEEDS * BITS})"


def product(a: str, b: str) -> Column:
    """The scalar product of the counts of two fingerprints."""
    both = f"double(x & {SLOT}L) * double(y & {SLOT}L) + double(x >> 31) * double(y >> 31)"
    return F.expr(f"aggregate(zip_with({_counts(a)}, {_counts(b)}, (x, y) -> {both}), 0D, (p, q) -> p + q)")


def sums(v: str) -> Column:
    """Of a fingerprint ``one``, the sum of its counts, and ``two``, their scalar product with themselves."""
    one = F.expr(f"aggregate({_counts(v)}, 0D, (p, x) -> p + double(x & {SLOT}L) + double(x >> 31))")
    return F.struct(one.alias("one"), product(v, v).alias("two"))


def likeness(a: Column, b: Column, a_sums: Column, b_sums: Column, ab: Column) -> Column:
    """The estimated share of stretches in common, 0 to 1; 1 for equal fingerprints.

    ``a_sums`` and ``b_sums``: their ``sums``; ``ab``: their scalar product. With c counts of n stretches the sums of signs are 2 c - n.
    """

    def signs(xy: Column, x: Column, y: Column, m: Column, n: Column) -> Column:
        return 4 * xy - 2 * (m * y + n * x) + (2 * SEEDS * BITS) * m * n

    m, n = F.get(a, F.lit(0)).cast("double"), F.get(b, F.lit(0)).cast("double")
    size = signs(a_sums["two"], a_sums["one"], a_sums["one"], m, m) + signs(b_sums["two"], b_sums["one"], b_sums["one"], n, n)
    share = F.when(size > 0, F.greatest(F.lit(0.0), 2 * signs(ab, a_sums["one"], b_sums["one"], m, n) / size)).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def as_text(v: Column) -> Column:
    """The fingerprint as hexadecimal digits."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def changes(old: Column, new: Column, kept: Column) -> Column:
    """The paragraphs that text ``new``, which begins with the ``kept`` first characters of ``old``, lacks (-1) and adds (1)."""
    same = F.size(F.split(F.substring(old, F.lit(1), kept), "\n"))  # lines before the one that is cut, and one
    rest = lambda text: F.filter(F.slice(F.split(text, "\n"), same, F.greatest(F.lit(0), F.size(F.split(text, "\n")) - same + 1)), lambda p: p != "")
    return F.concat(signed(rest(old), -1), signed(rest(new), 1))


def _followers(rows: DataFrame) -> DataFrame:
    """Of each row (w_key, w_id, w_n) of the order of ids the next one's key: ``w_next``, with ``w_take``, the characters that the row takes of it."""
    order = [F.col("w_id").asc_nulls_last(), F.col("w_key")]
    dealt = written(rows.repartitionByRange(*order).withColumn("w_range", F.spark_partition_id()), "fingerprint-order")
    inside = Window.partitionBy("w_range").orderBy(*order)
    place = F.struct(F.col("w_id").isNull().alias("none"), "w_id", "w_key")
    seams = dealt.groupBy("w_range").agg(F.min(place).alias("w_first"))  # one row per range
    ranges = Window.partitionBy(F.lit(0)).orderBy("w_range")
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seams = seams.select("w_range", F.coalesce(F.lead("w_first.w_key").over(ranges), F.first("w_first.w_key").over(whole)).alias("w_after"))
    out = dealt.withColumn("w_lead", F.lead("w_key").over(inside)).join(F.broadcast(seams), "w_range")
    return out.select("w_key", F.coalesce("w_lead", "w_after").alias("w_next"), F.floor(F.col("w_n") / 4).cast("int").alias("w_take"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text).cast("binary"), 256), F.lit(""))
    base = docs.select(key.alias("w_key"), F.col(id_col).alias("w_id"), text.alias("w_text"))
    narrow = base.groupBy("w_key").agg(F.min("w_id").alias("w_id"), F.max(F.char_length("w_text")).alias("w_n"), F.count(F.lit(1)).alias("w_rows"))
    narrow = written(narrow, "fingerprint-ids")
    most = narrow.agg(F.max("w_rows")).first()[0] or 0
    next_of = written(_followers(narrow.select("w_key", "w_id", "w_n")), "fingerprint-next")
    # fully repeated rows count once; copies are dropped in each task first
    single = base.select("w_key", "w_text") if most <= 1 else base.select("w_key", "w_text").dropDuplicates(["w_key"])
    own = summed(single, ["w_key"], signed(paragraphs(F.col("w_text")), 1))
    own = own.select("w_key", plus("w_sum", _array(*[0] * NUMBERS)).alias("w_own"))
    own = own.withColumn("w_own2", sums("w_own"))
    # both sides of the texts read the same exchange, and those of the fingerprints theirs; an opening and a fingerprint go to the document before
    asked = next_of.select(F.col("w_key").alias("w_for"), F.col("w_next").alias("w_key"), "w_take")
    opened = single.join(asked, "w_key").select(F.col("w_for").alias("w_key"), F.expr("substring(w_text, 1, w_take)").alias("w_open"))
    given = own.join(asked.drop("w_take"), "w_key").select(F.col("w_for").alias("w_key"), F.col("w_own").alias("w_next"), F.col("w_own2").alias("w_next2"))
    n = F.char_length("w_text")
    met = single.join(narrow.select("w_key", "w_id", "w_rows"), "w_key").join(opened, "w_key").withColumn("n_chars", n.cast("long"))
    take = F.floor(F.col("n_chars") / 4).cast("int")
    # a repeated row is followed by its copy, except for the last
    last = F.struct(F.lit(False).alias("w_again"), F.col("w_open").alias("w_open"))
    again = F.struct(F.lit(True).alias("w_again"), F.expr("substring(w_text, 1, cast(floor(n_chars / 4) as int))").alias("w_open"))
    if most > 1:
        met = met.withColumn("w_case", F.explode(F.when(F.col("w_rows") > 1, F.array(last, again)).otherwise(F.array(last))))
    else:
        met = met.withColumn("w_case", last)
    kept = (F.col("n_chars") - take).cast("int")
    met = met.withColumn("w_new", F.concat(F.substring(F.col("w_text"), F.lit(1), kept), F.col("w_case.w_open")))
    met = met.withColumn("edited_sha256", F.coalesce(F.sha2(F.col("w_new").cast("binary"), 256), F.lit(""))).withColumn("w_again", F.col("w_case.w_again"))
    edits = summed(met, ["w_key", "w_id", "w_rows", "w_again", "n_chars", "edited_sha256"], changes(F.col("w_text"), F.col("w_new"), kept))
    rows = edits.join(own, "w_key").join(given, "w_key")
    rows = rows.withColumn("w_edited", plus("w_own", "w_sum"))
    rows = rows.withColumn("w_next", F.when(F.col("w_again"), F.col("w_own")).otherwise(F.col("w_next"))).withColumn("w_next2", F.when(F.col("w_again"), F.col("w_own2")).otherwise(F.col("w_next2")))
    near = lambda other, other_sums: likeness(F.col("w_own"), F.col(other), F.col("w_own2"), other_sums, product("w_own", other))
    out = rows.select(
        "w_key", "w_id", "n_chars", "edited_sha256", as_text(F.col("w_own")).alias("fingerprint"), as_text(F.col("w_edited")).alias("edited_fingerprint"),
        near("w_edited", sums("w_edited")).alias("near_edited"), near("w_next", F.col("w_next2")).alias("near_next"),
        F.when(F.col("w_again"), F.col("w_rows") - 1).otherwise(_long(1)).alias("w_times"),
    )
    if most > COPIES:  # very many copies of one row are written by many tasks
        share = F.explode(F.transform(F.sequence(_long(0), F.floor((F.col("w_times") - 1) / COPIES)), lambda i: F.struct(i.alias("w_no"), F.least(_long(COPIES), F.col("w_times") - i * COPIES).alias("w_part"))))
        out = out.select("*", share.alias("w_share")).repartition("w_key", "w_share.w_no").withColumn("w_times", F.col("w_share.w_part"))
    if most > 1:
        out = out.withColumn("w_copy", F.explode(F.sequence(_long(1), F.col("w_times"))))
    return out.select(F.col("w_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
