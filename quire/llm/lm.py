"""Language-model scores from a weighted backoff automaton over smoothed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chunks import FAN, MESSAGE, corpus_counts, messages, n_chunks, opened, packed, range_bits, spread, text_bytes
from quire.llm.common import Scratch, mix, trim, word_hashes

START, END = np.uint64(0x5CA1AB1E0DDBA11), np.uint64(0xE4D0F7E47E4D0F7E)
STEP = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The distinct n-grams of a chunk of texts, and which of them ends at each token.

    Every text is START, its words, END. `sorted[k]` holds the distinct hashes, cut to their first `bits` bits, of the (k+1)-grams that end
    at a word or END within one text; `at[k][i]` is the place there of the one that ends at token i, -1 if none.
    """

    def __init__(self, texts: list[str | None], order: int, bits: int = 64):
        hashes = [word_hashes(t) for t in texts]
        lengths = np.array([len(t) for t in hashes], dtype=np.int64)
        self.ends = np.cumsum(lengths + 2)  # one past each text's END
        self.starts = self.ends - lengths - 2
        h = np.empty(int(self.ends[-1]) if len(texts) else 0, dtype=np.uint64)
        inside = np.ones(len(h), dtype=bool)
        inside[self.starts], inside[self.ends - 1] = False, False
        h[inside] = np.concatenate(hashes) if hashes else 0
        h[self.starts], h[self.ends - 1] = START, END
        depth = np.arange(len(h)) - np.repeat(self.starts, lengths + 2)
        self.sorted, self.at = [], []
        grams = h
        for k in range(order):
            if k:
                longer = np.zeros_like(h)
                with np.errstate(over="ignore"):
                    longer[1:] = mix(grams[:-1] * STEP + h[1:])
                grams = longer
            valid = depth >= max(k, 1)
            distinct, place = np.unique(grams[valid] >> np.uint64(64 - bits), return_inverse=True)
            at = np.full(len(h), -1, dtype=np.int64)
            at[valid] = place
            self.sorted.append(distinct)
            self.at.append(at)

    def counts(self, learn: np.ndarray) -> list[np.ndarray]:
        """How often each distinct n-gram occurs in the texts that are learnt from."""
        taught = np.repeat(learn, self.ends - self.starts)
        return [np.bincount(at[taught & (at >= 0)], minlength=len(s)) for at, s in zip(self.at, self.sorted, strict=True)]


def traverse(known: list[bool], arcs: list[list], falls: list[list]) -> float:
    """One left-to-right walk over a text's tokens; START has set the first state.

    `arcs[k][i]` is the weight of the arc by token i out of the state of k words, nan if there is none;
    `falls[k][i]` is the weight of that state's failure arc. The state is the number of words of history
    that the automaton still holds; after a word that it does not know that is none.
    """
    longest = len(arcs) - 1
    total, state = 0.0, min(1, longest)
    for i in range(len(known)):
        weight = arcs[state][i]
        while weight != weight:
            total += falls[state][i]
            state -= 1
            weight = arcs[state][i]
        total += weight
        if not known[i]:
            state = 0
        elif state < longest:
            state += 1
    return total


def score(
    docs: DataFrame,
    learn: str,
    scratch: Scratch,
    text: str = "text",
    order: int = 2,
    strength: float = 128.0,
    chunk_bytes: int = 8 << 20,
    fan: int = FAN,
) -> DataFrame:
    """`docs` without its text and `learn` column, with n_tokens, n_known, train_tokens, base_score and score.

    The model: counts of all n-grams up to `order` in every text whose `learn` is true. An n-gram's
    probability is (c(hw) + s P(w|h')) / (c(h) + s) with s = `strength`, so a state h has an arc for
    each word seen after it and a failure arc of weight s / (c(h) + s) to its suffix h'; the empty state's
    are the add-half base probabilities, where one more, unknown word has its share.

    Counts never sit in one place. Texts are packed into chunks of about `chunk_bytes` in the shared folder.
    Each chunk sends its distinct n-gram hashes (27 bits more than name a byte of the corpus, 64 at most; sorted, packed as differences) with its counts to
    ranges of the hash space, `fan` messages an order at most; ranges add the counts, through blocks of chunks if there are more than
    `fan` chunks, and answer each chunk with the corpus's counts of just its n-grams. So a word that is in every text costs one entry a chunk,
    and a chunk's automaton is held by the one worker that walks its texts. The driver gets two sums.

    Null and empty texts are the END token alone. Null keys, repeated rows and further columns pass
    through; result names that clash with input columns replace them. An empty table gives no rows.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rows = docs.drop(*made).withColumn(learn, F.coalesce(F.col(learn), F.lit(False)))
    size = text_bytes(rows, text)
    chunks = scratch.save(packed(rows, text, chunk_bytes), "chunks")
    senders = n_chunks(size, chunk_bytes)
    bits, more = min(64, math.ceil(math.log2(size)) + 27), range_bits(senders, fan)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, blob in zip(pdf["chunk"], pdf["packed"], strict=True):
                found = opened(blob)
                grams = Grams(found.column(text).to_pylist(), order, bits)
                counts = grams.counts(found.column(learn).to_numpy())
                for k, (h, c) in enumerate(zip(grams.sorted, counts, strict=True)):
                    yield pd.DataFrame(messages(k, chunk, h, c, 0, 0, more, bits), columns=["k", "part", "sender", "keys", "counts"])
                del grams, counts, found
                trim()

    answers = corpus_counts(chunks.mapInPandas(send, MESSAGE), senders, bits, scratch, "lm", fan)
    n_train, vocabulary = (x or 0 for x in answers.where("sender = -1 AND k = 0").agg(F.sum("n"), F.sum("v")).first())
    rest = [f for f in rows.schema if f.name not in (text, learn)]

    def walk(_: tuple, held: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        out = []
        counted = counted.sort_values(["k", "part"])
        for blob in held["packed"]:
            found = opened(blob)
            grams = Grams(found.column(text).to_pylist(), order, bits)
            seen = []
            for k in range(order):
                c = [spread(b) for b in counted["counts"][counted["k"] == k]]
                c = np.append(np.concatenate(c) if c else np.zeros(0, np.uint64), 0).astype(np.int64)
                seen.append(c[grams.at[k]])
            ends = seen[0][grams.ends - 1]  # END is in every learnt text, as START is
            seen[0][grams.starts] = ends
            base = (seen[0] + 0.5) / (n_train + 0.5 * (vocabulary + 1))
            arcs, falls, p = [np.log10(base)], [base], base  # the empty state never fails
            for k in range(1, order):
                context = np.concatenate([[0], seen[k - 1][:-1]])
                q = (seen[k] + strength * p) / (context + strength)
                arcs.append(np.where(seen[k] > 0, np.log10(q), np.nan))
                falls.append(np.log10(strength / (context + strength)))
                p = np.where(seen[k] > 0, q, strength / (context + strength) * p)
            known = seen[0] > 0
            n_known = np.concatenate([[0], np.cumsum(known)])
            sums = [float(np.log10(base[s + 1 : e]).sum()) for s, e in zip(grams.starts, grams.ends, strict=True)]
            scores = [
                traverse(known[s + 1 : e].tolist(), [a[s + 1 : e].tolist() for a in arcs], [f[s + 1 : e].tolist() for f in falls])
                for s, e in zip(grams.starts, grams.ends, strict=True)
            ]
            table = found.select([f.name for f in rest])
            table = table.append_column("n_tokens", pa.array(grams.ends - grams.starts - 1))
            table = table.append_column("n_known", pa.array(n_known[grams.ends] - n_known[grams.starts + 1]))
            table = table.append_column("train_tokens", pa.array(np.full(len(table), n_train, dtype=np.int64)))
            table = table.append_column("base_score", pa.array(sums, pa.float64()))
            out.append(table.append_column("score", pa.array(scores, pa.float64())))
        frame = pa.concat_tables(out).to_pandas(integer_object_nulls=True)
        del out
        trim()
        return frame

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return chunks.groupBy("chunk").cogroup(answers.where("sender >= 0").groupBy("sender")).applyInPandas(walk, schema)
