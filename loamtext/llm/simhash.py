"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits link at ``MAX_BITS`` or fewer differing bits.  Such a pair
differs in at most ``MAX_BITS`` of its 8 bytes, so it shares at least 8 - MAX_BITS = 6
positional bytes.  A list keyed by one positional byte would hold 1/256 of all
fingerprints, and candidates would grow with the square of the input; so a list is keyed
by four (position, value) bytes, one list for each of the 14 ``BLOCKS``.  These are the
sets of four positions whose numbers cancel out under XOR: any three positions lie in
exactly one of them.  So the number of lists in which a pair meets tells how many
positional bytes it shares: 14 lists for 8 bytes, 7 for 7, 3 for 6, 1 for 5, and 1 or 0 for 4.
The index is scanned for pairs, the lists of each pair are tallied, and the pairs that reach
the guaranteed minimum (3 lists at two bits, :func:`least_lists`) are retained; their
Hamming distance is then verified.

Rows with one fingerprint are one entry of the index.  A list of more than
``LIST_LIMIT`` distinct fingerprints is not paired off: each of its fingerprints enters
the 65 lists of the values at distance 0 or 1 from it.  Two fingerprints share such a
value exactly if they differ in at most two bits, so linking each to the least one of
the list keeps every connection, with work linear in the size of the list.  A pair whose
tally lacks a long list lies in it with both its ends, so it is linked there.

Defined results: a null text has no words and fingerprint zero, like a blank one, and
zero links like any other; repeated rows belong to one component; a null id is ignored
as a component's least id (null if all its ids are null); an empty table gives an empty
table.  Other columns are not read (:func:`one_of_each` carries them under any names).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamtext.llm.common import in_arrow, written
from loamtext.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
LIST_LIMIT = 16
#: Positions of the bytes that key a list: the 4-subsets of 0..7 whose XOR is 0.
BLOCKS = [b for b in combinations(range(8), 4) if not b[0] ^ b[1] ^ b[2] ^ b[3]]
#: Shingles whose bits are counted in one step.
STEP = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words are one shingle, none give none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    k = min(shingle, len(words))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(words) - k + 1)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[at : at + STEP].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, k2, fp)`` for each row: fp as a signed long, k2 a hash of the text; written."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([simhash(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made)], ["id", "k2", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(2), text_col).alias("k2"), F.col(text_col).alias("t"))
    return written(in_arrow(rows, run, f"id {id_type}, k2 long, fp long"), "fingerprints")


def least_lists(max_bits: int) -> int:
    """The lists that a pair shares at least: blocks without any of ``max_bits`` positions."""
    return min(sum(not set(b) & set(gone) for b in BLOCKS) for gone in combinations(range(8), max_bits))


def _postings(distinct: DataFrame) -> DataFrame:
    """(key, fp): a list for each block of positions and the values of its bytes."""
    byte = [F.shiftrightunsigned(F.col("fp"), 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    keys = [sum((F.shiftleft(byte[p], 8 * i) for i, p in enumerate(b)), F.lit(n << 32)) for n, b in enumerate(BLOCKS)]
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def tallied(short_lists: DataFrame) -> DataFrame:
    """(u, v, n): the number of lists ``(key, fp)`` in which two fingerprints meet."""
    lists = short_lists.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    later = lambda x, i: F.transform(F.slice("fps", i + 2, F.size("fps")), lambda y: F.struct(x.alias("u"), y.alias("v")))
    met = lists.select(F.explode(F.flatten(F.transform("fps", later))).alias("p"))
    return met.groupBy("p.u", "p.v").agg(F.count(F.lit(1)).alias("n"))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Links (u, v) between distinct fingerprints that keep every connection."""
    if not 0 <= max_bits <= 2:
        raise ValueError("long lists are linked through values at distance 1, which reaches two differing bits")
    postings = written(_postings(distinct), "postings")
    sizes = written(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "posting_sizes")
    some = postings.join(sizes.where(F.col("n") <= list_limit).select("key"), "key")
    many = postings.join(sizes.where(F.col("n") > list_limit).select("key"), "key")
    retained = tallied(some).where(F.col("n") >= least_lists(max_bits))
    pairs = retained.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).select("u", "v")

    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0))) for k in range(64)))
    centred = many.select("fp").distinct().select("fp", F.explode(around).alias("centre"))
    least = centred.groupBy("centre").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most")
    starred = centred.join(least, "centre").where("fp > least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    starred = starred.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits) if max_bits == 2 else _narrow(many, max_bits)
    return pairs.union(starred)


def _narrow(many: DataFrame, max_bits: int) -> DataFrame:
    """Links at fewer than two bits within long lists: a value meets its one-bit neighbours."""
    fps = many.select("fp").distinct()
    flips = F.array(*(F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0))) for k in range(64)))
    other = fps.select(F.col("fp").alias("u"), F.explode(flips).alias("v"))
    return other.join(fps.select(F.col("fp").alias("v")), "v").where("u < v").select("u", "v").where(F.lit(max_bits == 1))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``id, k2, fp, component, component_id`` for each row.

    ``component`` is the least fingerprint of the component, ``component_id`` its least id.
    """
    prints = fingerprints(docs, id_col, text_col, shingle)
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "classes")
    found = components(links(classes.select("fp"), max_bits, list_limit))
    labelled = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("label", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    member = labelled.join(least, "component").select("fp", "component", "component_id")
    return prints.join(member, "fp").select("id", "k2", "fp", "component", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: DataFrame | None = None, **settings) -> DataFrame:
    """The row of the least id (then text hash) of each component; of equal rows, one.

    ``members(id, k2, component)`` are the components, by default those of :func:`near_duplicates`.
    """
    inner = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    if members is None:
        members = near_duplicates(docs, id_col, text_col, **settings)
    least = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "k2")).alias("m")).select("component", F.col("m.id").alias("mid"), F.col("m.k2").alias("k2"))
    rows = members.groupBy("component", "id", "k2").agg(F.count(F.lit(1)).alias("n"))
    chosen = rows.join(least, ["component", "k2"]).where(F.col("id").eqNullSafe(F.col("mid")))
    chosen = written(chosen.select(F.xxhash64(F.lit(1), "id").alias("k1"), "k2", "n"), "chosen")
    keyed = docs.toDF(*inner.values()).withColumns({"k1": F.xxhash64(F.lit(1), inner[id_col]), "k2": F.xxhash64(F.lit(2), inner[text_col])})
    once = keyed.join(chosen.where("n = 1").select("k1", "k2"), ["k1", "k2"], "left_semi")
    often = chosen.where("n > 1").select("k1", "k2")
    if not often.isEmpty():
        once = once.union(keyed.join(often, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return once.select(*(F.col(v).alias(c) for c, v in inner.items()))
