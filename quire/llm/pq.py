"""Embedding near-duplicates by product quantisation over inverted lists, with an exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, trim, whole_numbers
from quire.llm.components import connected_components

CODES = 256


#: Distances are worked out for so many vectors times centres at once (32 MB of doubles).
TILE = 1 << 22


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, a block of vectors at a time."""
    out, norms = np.empty(len(x), dtype=np.int64), (centres**2).sum(1)
    step = max(1, TILE // len(centres))
    for at in range(0, len(x), step):
        out[at : at + step] = np.argmin(norms - 2 * x[at : at + step] @ centres.T, axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        sizes = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


@dataclass
class Index:
    """What every worker holds: at most `max_lists` list centres and 256 codewords a subspace."""

    centres: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, n_lists: int, n_subspaces: int, seed: int) -> Index:
        rng = np.random.default_rng(seed)
        centres = _kmeans(sample, min(n_lists, len(sample)), 8, rng)
        residual = sample - centres[_nearest(sample, centres)]
        cuts = np.linspace(0, sample.shape[1], min(n_subspaces, sample.shape[1]) + 1).astype(int).tolist()
        books = [_kmeans(residual[:, a:b], min(CODES, len(sample)), 6, rng) for a, b in zip(cuts, cuts[1:], strict=False)]
        return Index(centres, cuts, books)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, how far each residual is from what its codes stand for)."""
        codes, square = np.empty((len(residual), len(self.books)), dtype=np.uint8), np.zeros(len(residual))
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = _nearest(part, book)
            square += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(square)

    def probes(self, x: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(nearest list, which lists to probe).

        A vector y is in another list c' only if it lies beyond the plane half way between x's nearest centre
        and c'. So the list is probed if that plane is at most `slack` away from x.
        """
        square = np.maximum((x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T, 0)
        nearest = np.argmin(square, axis=1)
        own = self.centres[nearest]
        apart = np.sqrt(np.maximum((own**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * own @ self.centres.T, 1e-30))
        near = square - square[np.arange(len(x)), nearest][:, None] <= 2 * slack * apart + 1e-9
        near[np.arange(len(x)), nearest] = True
        return nearest, near

    def probed(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray, slack: float) -> np.ndarray:
        """Whether each vector of the list `home` probes the other list that is named for it; as `probes` says."""
        own, other = self.centres[home], self.centres[lists]
        apart = np.sqrt(np.maximum(((own - other) ** 2).sum(1), 1e-30))
        return ((x - other) ** 2).sum(1) - ((x - own) ** 2).sum(1) <= 2 * slack * apart + 1e-9

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries (as residuals of the list's centre) to coded vectors, by table lookup."""
        out = np.zeros((len(residual), len(codes)), dtype=np.float32)
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            lookup = ((part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T).astype(np.float32)
            out += lookup[:, codes[:, m]]
        return out


def _unit(blobs: pd.Series, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is too large or too small
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_groups(
    vectors: DataFrame,
    scratch: Scratch,
    key: str = "vec_id",
    column: str = "embedding",
    threshold: float = 0.95,
    sample_rows: int = 20_000,
    max_lists: int = 16_384,
    n_subspaces: int = 8,
    sigmas: float = 3.0,
    block: int = 2048,
    seed: int = 1,
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of `vectors`, linked by cosine `threshold` or more.

    Only vectors of one length can be near; each length that occurs has an index of its own. It (list centres, residual
    codebooks) is fitted on `sample_rows` vectors at most, those of
    smallest hash; every vector is indexed. Equal vectors are one node with a count. A query probes all lists
    whose boundary is within `slack` of it. A near vector is r = sqrt(2 - 2 threshold) away at most, and its offset
    along one direction has a standard deviation of r / sqrt(length) if it points anywhere; slack is `sigmas` of
    these, r at most, at which nothing can be missed (sigmas = inf). Within a list, table-lookup distances rule
    out what is further than r plus the code's own known error, which loses nothing; the rest is reranked by
    cosine in double precision, so no pair below the threshold is linked. A pair found counts for both its ends, whichever
    of them found it.

    Lists and their queries are cut into blocks of `block`, so a list may hold any share of the vectors. A
    block returns one row a vector: its number of links there and the smallest node of its links' closure. Pairs are never
    listed. The driver holds the sample and two counts a list; the workers hold `max_lists` centres at most.

    Null, empty, zero, non-finite or null-holding vectors link with nothing; so do rows with a null key, whose component
    is null and kept false. Components of any finite size count. Keys are whole numbers. Every
    row counts, repeated keys too. Further columns are ignored. An empty table gives no rows.
    """
    whole_numbers(vectors, key)
    kind = "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("x"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blobs = []
            for x in pdf["x"]:
                x = None if x is None else np.asarray(x, dtype=np.float64)
                good = x is not None and x.ndim == 1 and len(x) and np.isfinite(x).all() and (x != 0).any()
                blobs.append(x.astype(kind).tobytes() if good else None)
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "raw": blobs})

    nulls = F.exists("x", lambda v: v.isNull())
    safe = rows.select("id", F.when(~nulls, F.col("x")).alias("x"))
    cleaned = scratch.save(safe.mapInPandas(clean, "id long, raw binary"), "vectors")
    usable = F.col("raw").isNotNull() & F.col("id").isNotNull()
    nodes = scratch.save(cleaned.where(usable).groupBy("raw").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "nodes")
    lengths = [r["n"] for r in nodes.groupBy(F.length("raw").alias("n")).count().orderBy("n").collect()]
    found = None
    for n in lengths:
        own = nodes if len(lengths) == 1 else nodes.where(F.length("raw") == n)
        links = _links(own, scratch, f"{n}-", kind, n // int(kind[-1]), threshold, sample_rows, max_lists, n_subspaces, sigmas, block, seed)
        found = links if found is None else found.union(links)
    if found is None:
        return cleaned.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "cc")
    named = nodes.join(counts, "node", "left").join(comps, "node", "left")
    named = named.select("raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = cleaned.where(usable).join(named, "raw").select("id", "n_links", "component_id")
    alone = cleaned.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(
    nodes: DataFrame, scratch: Scratch, label: str, kind: str, dim: int, threshold: float, sample_rows: int, max_lists: int, n_subspaces: int, sigmas: float, block: int, seed: int
) -> DataFrame:
    """(node, links, root): for the nodes (raw, node, copies) of one length, links found and a smaller node of the same component."""
    n_nodes = nodes.count()
    picked = nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(sample_rows).select("raw").toPandas()
    n_lists = int(np.clip(round(2 * np.sqrt(n_nodes)), 1, max_lists))
    index = Index.fit(_unit(picked["raw"], kind), n_lists, n_subspaces, seed)
    n_lists = len(index.centres)
    shared = nodes.sparkSession.sparkContext.broadcast(index)  # max_lists centres and 256 codewords a subspace at most; goes with the session, as its reader may be lazy
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    slack = radius * min(1.0, sigmas / np.sqrt(dim))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), block):
                part = pdf.iloc[at : at + block]
                x = _unit(part["raw"], kind)
                nearest, near = index.probes(x, slack)
                codes, error = index.encode(x - index.centres[nearest])
                probes = [np.flatnonzero(n).astype(np.int32) for n in near]
                yield part.assign(list=nearest.astype(np.int32), code=[c.tobytes() for c in codes], error=error, probes=probes)

    coded = scratch.save(nodes.mapInPandas(assign, "raw binary, node long, copies long, list int, code binary, error double, probes array<int>"), f"{label}coded")
    held = dict(coded.groupBy("list").count().collect())
    asked = dict(coded.select(F.explode("probes").alias("list")).groupBy("list").count().collect())
    parts = [(c, -(-held[c] // block), -(-asked[c] // block)) for c in held if c in asked]
    sizes = F.broadcast(nodes.sparkSession.createDataFrame(parts, "list int, n_held int, n_asked int"))  # a row a list, max_lists at most
    spot = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = coded.join(sizes, "list").select("list", spot(seed, "n_held").alias("i"), each("n_asked").alias("j"), "node", "copies", "raw", "code", "error", F.lit(None).cast("int").alias("home"))
    queries = coded.select("node", "copies", "raw", F.col("list").alias("home"), F.explode("probes").alias("list")).join(sizes, "list")
    queries = queries.select(
        "list", each("n_held").alias("i"), spot(seed + 1, "n_asked").alias("j"), "node", "copies", "raw", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error"), "home"
    )

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        index, centre = shared.value, shared.value.centres[key[0]]
        ask, have = pdf[pdf["home"].notna()], pdf[pdf["home"].isna()]
        if not len(ask) or not len(have):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype(np.int64)
        q, y = _unit(ask["raw"], kind), _unit(have["raw"], kind)
        codes = np.frombuffer(b"".join(have["code"]), dtype=np.uint8).reshape(len(have), -1)
        reach = ((radius + have["error"].to_numpy()) ** 2 + 1e-3).astype(np.float32)
        ids, others, copies = ask["node"].to_numpy(), have["node"].to_numpy(), have["copies"].to_numpy()
        home, weight = ask["home"].to_numpy(dtype=np.int64), ask["copies"].to_numpy()
        left, right, back = [], [], np.zeros(len(y))
        for at in range(0, len(q), 512):
            i, j = np.nonzero(index.distances(q[at : at + 512] - centre, codes) <= reach)
            for cut in range(0, len(i), 1 << 18):
                a, b = i[cut : cut + (1 << 18)] + at, j[cut : cut + (1 << 18)]
                hit = (np.einsum("nd,nd->n", q[a], y[b]) >= threshold) & (ids[a] != others[b])
                a, b = a[hit], b[hit]
                left.append(a.astype(np.int32))
                right.append(b.astype(np.int32))
                far = home[a] != key[0]
                a, b = a[far], b[far]  # whose other end sees them from its own side only if it probes their list
                unseen = ~index.probed(y[b], np.full(len(b), key[0]), home[a], slack)
                back += np.bincount(b[unseen], weights=weight[a[unseen]], minlength=len(y))
        a, b = np.concatenate(left or [np.zeros(0, np.int32)]), np.concatenate(right or [np.zeros(0, np.int32)])
        links = np.bincount(a, weights=copies[b], minlength=len(q)).astype(np.int64)
        low_q, low_y = ids.copy(), others.copy()
        while len(a):  # the smallest node of each component of this block's links
            before = low_q.sum() + low_y.sum()
            np.minimum.at(low_y, b, low_q[a])
            np.minimum.at(low_q, a, low_y[b])
            if low_q.sum() + low_y.sum() == before:
                break
        trim()
        at, to = np.unique(a), np.unique(b)
        return pd.DataFrame({"node": np.concatenate([ids[at], others[to]]), "links": np.concatenate([links[at], back[to].astype(np.int64)]), "root": np.concatenate([low_q[at], low_y[to]])})

    return scratch.save(base.union(queries).groupBy("list", "i", "j").applyInPandas(search, "node long, links long, root long"), f"{label}found")
