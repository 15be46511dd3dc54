"""Exact Jaccard self-join of word-shingle sets with adaptive multi-match prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chunks import FAN, MESSAGE, corpus_counts, messages, n_chunks, opened, packed, range_bits, spread, spread_sorted, squeeze_sorted, text_bytes
from quire.llm.common import Scratch, mix, rolled, signed, trim, whole_numbers, word_hashes
from quire.llm.components import connected_components

#: Longest multi-match requirement, and the weight of a verification against reading a posting.
LONGEST, VERIFY = 4, 8.0
STAR_ROUNDS = 2
#: A shingle is paired by join while that gives at most so many pairs a posting; beyond, its sets are compared in blocks.
PAIRS, BLOCK = 16, 256


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than a shingle make one shingle."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    found = np.sort(rolled(hashes, min(width, len(hashes))))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed halves; equal sets have equal names."""
    both = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


def prefix(shingles: np.ndarray, frequency: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """(places of the set's prefix, the number of shared prefix shingles that it requires).

    Shingles are ordered by frequency, then hash. Two sets of Jaccard at least num/den share l shingles of their first
    n - ceil(n num/den) + l, and the smaller of two requirements holds for both. The l of least estimated cost is
    taken: postings read plus verifications, of which there are at most postings / l.
    """
    n = len(shingles)
    order = np.lexsort((shingles, frequency))
    need = -(-n * num // den)
    choices = np.arange(1, min(LONGEST, need) + 1)
    lengths = n - need + choices
    reads = np.cumsum(frequency[order].astype(np.float64) - 1)[lengths - 1]
    best = int(np.argmin(reads * (1 + VERIFY / choices)))
    return order[: lengths[best]], int(choices[best])


def _sets(docs: DataFrame, key: str, text: str, width: int, num: int, den: int, scratch: Scratch, label: str, chunk_bytes: int, fan: int) -> DataFrame:
    """A row (id, chunk, n, s1, s2, l, head, shingles) for every document; s1 and s2 name its set.

    head: its prefix shingles that occur in other sets too; null, with l and shingles, if they are fewer than l, which rules out
    any link, or if the chunk has the set already.

    Frequencies are counted over all documents by shortened hashes (13 bits more than the corpus has shingles, so that few share
    one): each chunk sends its distinct ones to ranges of the hash space, which answer with their sums. A shared short hash
    only makes a shingle look more frequent, to all sets alike.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    size = text_bytes(rows, "text")
    bits = int(np.clip(math.ceil(math.log2(size)) + 11, 32, 64))
    drop = np.uint64(64 - bits)
    senders = n_chunks(size, chunk_bytes)
    more = range_bits(senders, fan)
    chunks = scratch.save(packed(rows, "text", chunk_bytes), f"{label}-chunks")

    def built(blob: bytes) -> tuple[list, list[np.ndarray], list[tuple[int, int]], np.ndarray]:
        """ids, sets, names and which documents are the first with a key of their set in the chunk."""
        found = opened(blob)
        sets = [shingle_set(t.as_py(), width) for t in found.column("text")]
        names = [set_name(s) for s in sets]
        ids = found.column("id").to_pylist()
        fresh, seen = np.zeros(len(names), dtype=bool), set()
        for at, (i, name) in enumerate(zip(ids, names, strict=True)):
            if i is not None and name not in seen:
                seen.add(name)
                fresh[at] = True
        return ids, sets, names, fresh

    def short(sets: list[np.ndarray], fresh: np.ndarray) -> np.ndarray:
        """Short hashes of the first sets, one set after the other."""
        return mix(np.concatenate([np.zeros(0, np.uint64), *(s for s, f in zip(sets, fresh, strict=True) if f)])) >> drop

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, blob in zip(pdf["chunk"], pdf["packed"], strict=True):
                _, sets, _, fresh = built(blob)
                keys, n = np.unique(short(sets, fresh), return_counts=True)
                yield pd.DataFrame(messages(0, chunk, keys, n, 0, 0, more, bits), columns=["k", "part", "sender", "keys", "counts"])
                trim()

    answers = corpus_counts(chunks.mapInPandas(send, MESSAGE), senders, bits, scratch, label, fan)

    def heads(group: tuple, held: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        out = []
        counts = [spread(b) for b in counted.sort_values("part")["counts"]]
        known = np.concatenate(counts) if counts else np.zeros(0, np.uint64)
        for blob in held["packed"]:
            ids, sets, names, fresh = built(blob)
            keys = short(sets, fresh)
            order = np.argsort(keys)
            ranked = keys[order]
            frequency = np.empty(len(keys), dtype=np.uint32)
            if len(keys):
                frequency[order] = known[np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))]
            at = 0
            for i, s, name, first in zip(ids, sets, names, fresh, strict=True):
                row = (i, group[0], len(s), *name, None, None, None)
                if first:
                    own = frequency[at : at + len(s)]
                    at += len(s)
                    if len(s):
                        places, need = prefix(s, own, num, den)
                        head = s[places[own[places] > 1]]
                        if len(head) >= need:
                            row = (*row[:5], need, signed(head), squeeze_sorted(s))
                out.append(row)
        frame = pd.DataFrame(out, columns=["id", "chunk", "n", "s1", "s2", "l", "head", "shingles"]).astype({"id": "Int64", "l": "Int32"})
        del out, held, counted, counts, known
        trim()
        return frame

    schema = "id long, chunk long, n long, s1 long, s2 long, l int, head array<long>, shingles binary"
    made = chunks.groupBy("chunk").cogroup(answers.where("sender >= 0").groupBy("sender")).applyInPandas(heads, schema)
    sets = scratch.save(made, f"{label}-sets")
    scratch.drop(f"{label}-chunks", *(f"{label}-{x}-{k}" for x in ("answers", "sent") for k in range(9)))
    return sets


def _plausible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (na, nb, la, lb, m, ...) that may reach num/den by their sizes and the m shared prefix shingles.

    The set whose prefix ends earlier has all its prefix matches in the other's prefix, so the intersection is at most m plus what
    one of the sets has beyond its prefix.
    """
    rest = [F.ceil(F.col(n) * num / den) - F.col(l) for n, l in (("na", "la"), ("nb", "lb"))]
    enough = (F.col("m") + F.greatest(*rest)) * (num + den) >= (F.col("na") + F.col("nb")) * num
    return pairs.where((F.col("m") >= F.least("la", "lb")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & enough)


def _verified(pairs: DataFrame, holders: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of set names whose sets reach num/den, counted on the whole sets."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = spread_sorted(a), spread_sorted(b)
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            place = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[place] == small).sum())
            out.append(den * both >= num * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    left = holders.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    right = holders.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(similar("sa", "sb")).select("a", "b")


def similar_groups(
    docs: DataFrame,
    scratch: Scratch,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    num: int = 3,
    den: int = 4,
    label: str = "jaccard",
    chunk_bytes: int = 6 << 20,
    fan: int = FAN,
) -> DataFrame:
    """(key, n_shingles, component_id) for every row of `docs`: groups linked by Jaccard num/den or more.

    Texts are lower-cased (A-Z) and split into words; a document's set is its distinct `width`-word
    shingles. Equal sets are one node, so copies never make pairs. Each set has an adaptive prefix of its rarest shingles; links
    are sought among sets that share prefix shingles, without listing all pairs of a group:

    - Star rounds: every set is verified against the set that leads most of its shared prefix shingles;
      the links are closed to components. Pairs within a component need no more work. A second round takes other leaders.
    - The rest, exactly, is all pairs of different components that share prefix shingles. Where a shingle has few of them, they
      are joined, counted, held against the bounds for their sizes and verified. Where it has many (families of texts that are
      alike, but not enough), its sets go to their family, which is cut into blocks of `BLOCK`; each two blocks are compared in
      memory and return one row a set, not their pairs.

    So a component is exactly one of the graph of all links. Shingles are known by 64-bit hashes, which need to differ only
    between two texts that are compared, sets by 128-bit ones.
    Null keys get a null component and link nothing else to it; empty and null texts have no shingles
    and are linked with nothing; a repeated key is one row each time it occurs. Keys are whole numbers; further columns are ignored.
    An empty table gives no rows.
    """
    whole_numbers(docs, key)
    sets = _sets(docs, key, text, width, num, den, scratch, label, chunk_bytes, fan)
    keyed = sets.where("id IS NOT NULL AND n > 0")
    nodes = keyed.groupBy("s1", "s2").agg(F.min("id").alias("low"), F.min(F.when(F.col("head").isNotNull(), F.col("chunk"))).alias("chunk"))
    nodes = scratch.save(nodes.withColumn("sid", F.monotonically_increasing_id()), f"{label}-nodes")  # numbers that stay, once written
    owned = keyed.where("head IS NOT NULL").select("s1", "s2", "chunk", "n", "l", "head", "shingles")
    holders = scratch.save(owned.join(nodes.where("chunk IS NOT NULL"), ["s1", "s2", "chunk"]).select("sid", "n", "l", "head", "shingles"), f"{label}-holders")
    named = scratch.save(sets.select("id", "n", "s1", "s2"), f"{label}-rows")
    scratch.drop(f"{label}-sets")
    each = holders.select("sid", "n", "l", F.explode("head").alias("h"))
    common = each.groupBy("h").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("h")
    postings = scratch.save(each.join(common, "h"), f"{label}-postings")
    n_postings = postings.count()
    found, comps = None, None
    for turn in range(STAR_ROUNDS if n_postings else 0):
        at = f"{label}-{turn}"
        now = postings.withColumn("c", F.col("sid"))
        if comps is not None:
            now = postings.join(comps, "sid", "left").withColumn("c", F.coalesce("c", "sid"))
        leads = now.groupBy("h").agg(F.min_by(F.struct("sid", "c", "n", "l"), F.xxhash64(F.lit(turn), "sid")).alias("lead"), F.min("c").alias("low"), F.max("c").alias("high"))
        leads = scratch.save(leads.where("low < high").select("h", "lead"), f"{at}-leads")
        stars = now.join(leads, "h").where("c <> lead.c")
        met = stars.groupBy(F.col("sid").alias("a"), F.col("lead.sid").alias("b")).agg(
            F.count("*").alias("m"), F.first("n").alias("na"), F.first("l").alias("la"), F.first("lead.n").alias("nb"), F.first("lead.l").alias("lb")
        )
        best = _plausible(met, num, den).groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b"))
        links = scratch.save(_verified(best, holders, num, den), f"{at}-new")
        if links.isEmpty():
            break
        found = scratch.save(found.union(links), f"{at}-links") if found is not None else links
        comps = _components(found, scratch, at)
    if n_postings:
        light, heavy = _remaining(postings, comps, scratch, label, num, den)
        links = _verified(light, holders, num, den).union(_families(heavy, holders, scratch, label, num, den))
        found = scratch.save(found.union(links) if found is not None else links, f"{label}-all-links")
        comps = _components(found, scratch, f"{label}-last")
    members = nodes.select("s1", "s2", "sid", "low")
    members = members.join(comps, "sid", "left").withColumn("c", F.coalesce("c", "sid")) if comps is not None else members.withColumn("c", F.col("sid"))
    lowest = members.groupBy("c").agg(F.min("low").alias("component_id"))
    whole = scratch.save(members.join(lowest, "c").select("s1", "s2", "component_id"), f"{label}-named")
    scratch.keep(f"{label}-rows", f"{label}-named")
    rows = named.join(whole, ["s1", "s2"], "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    got = connected_components(links, scratch, f"{label}-cc")
    return got.select(F.col("node").alias("sid"), F.col("component").alias("c"))


def _remaining(postings: DataFrame, comps: DataFrame | None, scratch: Scratch, label: str, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(plausible pairs (a, b) of sets of different components, the postings (h, sid, c) of shingles with too many pairs).

    A pair that shares one of the latter is left to them; any other pair has all its shared prefix shingles counted here.
    """
    now = postings.withColumn("c", F.col("sid"))
    if comps is not None:
        now = postings.join(comps, "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    now = scratch.save(now, f"{label}-placed")
    sums = now.groupBy("h", "c").agg(F.count("*").alias("k")).groupBy("h").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    sums = sums.where("s * s > q").select("h", (F.col("s") * F.col("s") - F.col("q") > 2 * PAIRS * F.col("s")).alias("many"))
    crossing = scratch.save(now.join(sums, "h"), f"{label}-crossing")
    few = crossing.where("NOT many")
    one = few.select("h", *(F.col(x).alias(y) for x, y in (("sid", "a"), ("n", "na"), ("l", "la"), ("c", "ca"))))
    two = few.select("h", *(F.col(x).alias(y) for x, y in (("sid", "b"), ("n", "nb"), ("l", "lb"), ("c", "cb"))))
    fits = (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    met = one.join(two, "h").where(fits).groupBy("a", "b").agg(F.count("*").alias("m"), *(F.first(x).alias(x) for x in ("na", "nb", "la", "lb")))
    light = scratch.save(_plausible(met, num, den).select("a", "b"), f"{label}-light")
    return light, crossing.where("many").select("h", "sid", "c")


def _families(heavy: DataFrame, holders: DataFrame, scratch: Scratch, label: str, num: int, den: int) -> DataFrame:
    """Links (a, b) that close to the same components as all links between sets that share a heavy shingle.

    Sets are a family if heavy shingles connect them. A family's blocks are dealt out by hash, every two to a task.
    """
    lows = heavy.groupBy("h").agg(F.min("sid").alias("low"))
    kin = connected_components(heavy.join(lows, "h").select(F.col("sid").alias("a"), F.col("low").alias("b")).distinct(), scratch, f"{label}-kin")
    kin = scratch.save(kin.select(F.col("node").alias("sid"), F.col("component").alias("family")), f"{label}-families")
    sizes = kin.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = kin.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    members = placed.join(heavy.select("sid", "c").distinct(), "sid").join(holders.select("sid", "shingles"), "sid")
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "c", "shingles")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [spread_sorted(b) for b in pdf["shingles"]]
        sizes, owner = np.array([len(x) for x in sets]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        _, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = seen[place] > 1
        owner, place = owner[shared], np.unique(place[shared], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, int(place.max(initial=-1)) + 1, 4096):
            now = (place >= at) & (place < at + 4096)
            part = np.zeros((len(sets), 4096), dtype=np.float32)
            part[owner[now], place[now] - at] = 1
            both += part @ part.T
        trim()
        both = both.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - both
        c, block = pdf["c"].to_numpy(), pdf["block"].to_numpy()
        linked = (den * both >= num * union) & (c[:, None] != c[None, :])
        if key[1] != key[2]:  # pairs within a block have a task of their own
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(linked)
        sid = pdf["sid"].to_numpy()
        low = sid.copy()
        while len(a):  # the smallest set of each component of these links
            before = low.copy()
            np.minimum.at(low, a, before[b])
            if (low == before).all():
                break
        hit = np.unique(a)
        return pd.DataFrame({"a": sid[hit], "b": low[hit]})

    return dealt.groupBy("family", "i", "j").applyInPandas(compare, "a long, b long").where("a <> b")


def one_of_each(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group: that of the smallest key. Rows without a key or without words stay.

    Keys name documents: of rows with equal key and text one stays, and a key goes if its text is linked to a smaller key.
    """
    groups = scratch.save(similar_groups(docs, scratch, key, text), "groups")
    scratch.keep("groups")
    gone = groups.where(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = docs.join(gone, key, "left_anti")
    repeated = scratch.save(groups.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeated")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key, text]))
