"""Document fingerprints by Order MinHash; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, named, shuffle_width

KMER = 2
FUNCTIONS_LOG2 = 6
TUPLE = 2
#: A token is a single letter of a script without word breaks, or else a run of up to 16 letters, digits or other signs.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[{UNSPACED}]|[^\s{UNSPACED}]{{1,16}}"

_POSITION_BITS = 24
_POSITION = (1 << _POSITION_BITS) - 1


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_POSITION).cast("long"))


def _hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_POSITION).cast("long"))


def _packed(value: Column, place: Column) -> Column:
    return _hash(value).bitwiseOR(place)


def _same(a: Column, b: Column) -> Column:
    return F.shiftright(a, _POSITION_BITS).eqNullSafe(F.shiftright(b, _POSITION_BITS))


def order_minhash(text: Column, kmer: int = KMER, functions_log2: int = FUNCTIONS_LOG2, size: int = TUPLE) -> Column:
    """Signature of a text: one integer for each of ``2 ** functions_log2`` hash functions; empty for a text without tokens.

    Tokens are runs without ASCII white space, cut at 16 characters, and single letters of scripts without word breaks;
    a k-mer is ``kmer`` successive tokens (all of them, if there are fewer). Equal k-mers are numbered by occurrence in
    text order. Every hash function selects the ``size`` minimal numbered k-mers of the whole text (all, if there are
    fewer), puts them into text order and hashes the tuple; the entry holds the function's number and 16 bits of that.

    Function j is one base hash less j times 2 ** (64 - functions_log2), modulo 2 ** 64: a rotation, under which every
    numbered k-mer is as likely to be minimal as under a hash of its own. The minimal ones are those that follow the
    rotation's origin in the sorted base hashes, the first following the last, so one sort serves all functions.
    Functions with no k-mer between their origins select the same tuple. A k-mer and its position share a long (40 and
    24 bits), so that sorting needs no objects. Of a text of over 2 ** 24 tokens the position is that of a stretch of
    two, four or more tokens; selected k-mers of one stretch are ordered by their hashes.
    """
    functions = 1 << functions_log2
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def number(s: Column) -> Column:
        """(k-mer, position) in order to (k-mer with its occurrence number, position)."""
        at = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(at, lambda i: _same(F.get(s, i), F.get(s, i + 1)) & ~_same(F.get(s, i), F.get(s, i - 1)))
        ends = F.filter(at, lambda i: _same(F.get(s, i), F.get(s, i - 1)) & ~_same(F.get(s, i), F.get(s, i + 1)))
        single = F.filter(s, lambda x, i: ~_same(x, F.get(s, i - 1)) & ~_same(x, F.get(s, i + 1)))
        numbered = lambda x, o: _packed(F.xxhash64(_hash(x), o.cast("int")), _place(x))
        runs = F.flatten(F.zip_with(starts, ends, lambda a, b: F.transform(F.slice(s, a + 1, b - a + 1), numbered)))
        return F.concat(F.transform(single, lambda x: numbered(x, F.lit(0))), runs)

    def slot(x: Column) -> Column:
        """The number of the last function whose origin is not above a base hash."""
        return (F.shiftright(x, 64 - functions_log2) + (functions >> 1)).cast("int")

    def signature(s: Column) -> Column:
        """``s``: numbered k-mers by base hash."""
        n = F.size(s)
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (slot(F.get(s, i)) != slot(F.get(s, i - 1))))

        def tuple_hash(i: Column) -> Column:
            """Of the ``size`` values from i on, the first following the last."""
            ahead = F.slice(s, i + 1, size)
            members = F.concat(ahead, F.slice(s, 1, F.least(F.lit(size), n) - F.size(ahead)))
            ordered = F.array_sort(F.transform(members, lambda y: F.struct(_place(y).alias("p"), _hash(y).alias("h"))))
            return F.xxhash64(F.transform(ordered, lambda y: y["h"])).bitwiseAND(F.lit(0xFFFF).cast("int"))

        def spread(first: Column) -> Column:
            """One value per function: those with an origin above the slot before and up to a slot share its tuple."""
            upto = lambda k: slot(F.get(s, F.get(first, k)))
            runs = F.transform(first, lambda i, k: F.array_repeat(tuple_hash(i), upto(k) - F.when(k == 0, -1).otherwise(upto(k - 1))))
            rest = F.array_repeat(tuple_hash(F.lit(0)), F.lit(functions - 1) - upto(F.size(first) - 1))
            return F.concat(F.flatten(runs), rest)

        return F.transform(let(firsts, spread), lambda v, j: (j * 65536 + v).cast("int"))

    def of_tokens(w: Column) -> Column:
        last = F.greatest(F.size(w) - kmer, F.lit(0))
        stretch = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.size(w) / (_POSITION + 1))), F.lit(0)))
        kmers = F.transform(F.sequence(F.lit(0), last), lambda i: _packed(F.xxhash64(*[F.get(w, i + j) for j in range(kmer)]), F.when(F.size(w) <= _POSITION + 1, i).otherwise(F.floor(i / stretch)).cast("long")))
        numbered = let(F.sort_array(kmers), number)
        return F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(let(F.sort_array(numbered), signature))

    return let(tokens, of_tokens)


def fingerprint_text(signature: Column) -> Column:
    """A signature as text: four hexadecimal digits per hash function."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFF))), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of hash functions that select the same tuple: 0 to 1; 1 for two empty signatures, 0 if one is empty."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def with_next(docs: DataFrame, carried: list[str], id_name: str = "id", tie: str = "text", derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds ``next_<c>`` of the row that follows in descending ``id`` (nulls last, then ``tie``); the first follows the last.

    ``derive`` adds costly carried columns; it runs before rows are shuffled, and once for each row but for those
    visiting another range. Rows are dealt into ranges of ids with at most one boundary row of the neighbouring range
    each, so no task sees all rows; range bounds and boundary ids (as many as ranges) are all that reaches the driver.
    """
    width = shuffle_width(docs.sparkSession)
    shares = [k / width for k in range(1, width)]
    bounds = sorted(set(docs.agg(F.percentile_approx(id_name, F.array(*map(F.lit, shares)), 10_000)).first()[0] or [])) if shares else []
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.coalesce(F.size(F.filter(table, lambda b: b < F.col(id_name))), F.lit(0)) if bounds else F.lit(0)
    bucket = F.when(F.col(id_name).isNull(), 0).otherwise(bucket)
    tops = docs.select(bucket.alias("bucket"), id_name).groupBy("bucket").agg(F.max(id_name).alias("top")).orderBy("bucket").collect()
    dealt = derive(docs.withColumns({"_bucket": bucket, "_guest": F.lit(0)})).select("_bucket", "_guest", id_name, *carried)
    if tops:
        # The first row of each range visits the range above it; the very first visits the lowest.
        visits = [(tops[k + 1]["bucket"] if k + 1 < len(tops) else tops[0]["bucket"], t["top"]) for k, t in enumerate(tops)]
        rows = F.array(*[F.struct(F.lit(b).alias("_bucket"), F.lit(t).cast("long").alias("_top")) for b, t in visits])
        guests = docs.sparkSession.range(1).select(F.inline(rows))
        few = docs.join(F.broadcast(guests), F.col(id_name).eqNullSafe(F.col("_top"))).drop("_top").withColumn("_guest", F.lit(1))
        dealt = dealt.unionByName(derive(few).select("_bucket", "_guest", id_name, *carried))
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col(id_name).desc_nulls_last(), tie)
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("_guest = 0").drop("_bucket", "_guest")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kmer: int = KMER, functions_log2: int = FUNCTIONS_LOG2, size: int = TUPLE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are to each other and to the next text's.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next document
    in descending id. Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``,
    one row per input row. A null text counts as empty, whose fingerprint is the empty string; a single document
    follows itself; rows with equal ids follow each other in the order of their texts.
    """
    source = named(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(source, ["text", "sig"], derive=lambda df: df.withColumn("sig", order_minhash(F.col("text"), kmer, functions_log2, size)))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = rows.select(
        "id", "sig", "next_sig", F.length("text").cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    ).withColumn("edited_sig", order_minhash(F.col("edited"), kmer, functions_log2, size))
    return edited.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_text(F.col("sig")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
