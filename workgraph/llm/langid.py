"""Language identification as inference of a mixture: each text's language shares by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh

BINS = 1 << 16
_LETTER = regex.compile(r"\p{L}")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def gram_bins(text: str) -> np.ndarray:
    """Hash bins of a text's byte trigrams: letters in lower case, everything else in ASCII a space, runs of spaces left out."""
    b = _KEEP[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[(b != 32) | (np.concatenate([[0], b[:-1]]) != 32)].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = seen.setdefault(lang, np.zeros(BINS, np.int64))
            n += np.bincount(gram_bins(text), minlength=BINS)
    for lang, n in seen.items():
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bin", "n"])


def _pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A language's counts (lang, bin, n) as one row, a number for each bin."""
    n = np.zeros(BINS, np.int64)
    for batch in batches:
        n[batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([n.tobytes()], pa.binary())], ["lang", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5, most_langs: int = 500) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [language, bin]) from every row of docs with a text and a language.

    Tasks count into BINS bins a language and Spark sums them, so what reaches the driver is a model of languages x BINS
    numbers, a packed row for each language (256 MB for most_langs), whatever the number of rows. More languages than that are an error, as the column then
    holds something else than languages. Null text or language: left out. Repeated rows count each time. Very long
    texts: whole. No rows: no languages.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    found = rows.select("lang").distinct().limit(most_langs + 1).count()
    if found > most_langs:
        raise ValueError(f"over {most_langs} languages")
    counts = rows.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    models = sorted(counts.groupBy("lang").applyInArrow(_pack, "lang string, n binary").collect(), key=lambda r: r["lang"])
    langs = [r["lang"] for r in models]
    table = np.stack([np.frombuffer(r["n"], np.int64) for r in models]).astype(float) if models else np.zeros((0, BINS))
    return langs, np.log((table + smooth) / (table.sum(axis=1, keepdims=True) + smooth * BINS)).astype(np.float32)


def _fit(p: np.ndarray, c: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares of the rows of p (language, gram) that make counts c likeliest, and the log-likelihood."""
    share = np.full(len(p), 1 / len(p))
    total, was = c.sum(), -np.inf
    for _ in range(rounds):
        joint = share @ p
        now = float(c @ np.log(joint))
        if now - was < 1e-3:
            break
        was = now
        share = share * (p @ (c / joint)) / total
    return share, now


def infer(bins: np.ndarray, logp: np.ndarray, penalty: float, rounds: int = 30, floor: float = 0.02) -> np.ndarray:
    """A text's language shares. All languages start; those under floor go, then whichever is worth less than penalty * log(grams) of log-likelihood, least first."""
    u, c = np.unique(bins, return_counts=True)
    lp = logp[:, u].astype(np.float64)
    top = lp.max(axis=0)
    p, c = np.exp(lp - top), c.astype(np.float64)
    share, _ = _fit(p, c, rounds)
    live = np.nonzero(share >= min(floor, share.max()))[0]
    cost = penalty * np.log(c.sum() + 1)
    part, like = _fit(p[live], c, rounds)
    while len(live) > 1:
        tries = [_fit(np.delete(p[live], i, axis=0), c, rounds) for i in range(len(live))]
        best = max(range(len(live)), key=lambda i: (tries[i][1], i))  # of equals the last goes
        if like - tries[best][1] >= cost:
            break
        part, like = tries[best]
        live = np.delete(live, best)
    out = np.zeros(len(logp))
    out[live] = part
    return out


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray, text_col: str = "text", penalty: float = 6.0, names: tuple[str, str, str] = ("lang_pred", "score", "lang_shares")) -> DataFrame:
    """docs with the predicted language, its share of the text (0 to 1), and the shares of all languages found.

    Null text, or one without a letter: 'und', 0.0 and no shares; so too every text where no language was learned. Ties
    go to the first language by name. Repeated rows get equal results. Very long texts: whole, as counts of BINS bins.
    Empty table: empty result. Columns of docs pass unchanged, but for ones named as a new one, which are replaced and
    stand last.
    """
    text, key = fresh(docs, "_t", "_found")
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))

    @F.pandas_udf("struct<lang:string,score:double,shares:map<string,double>>")
    def run(column):
        import pandas as pd

        names_, table = model.value
        out = []
        for t in column:
            if t is None or not names_ or not _LETTER.search(t):
                out.append(("und", 0.0, {}))
                continue
            share = infer(gram_bins(t), table, penalty)
            k = int(share.argmax())
            out.append((names_[k], float(min(1.0, share[k])), {names_[i]: float(share[i]) for i in np.nonzero(share)[0]}))
        return pd.DataFrame(out, columns=["lang", "score", "shares"])

    keep = [c for c in docs.columns if c.lower() not in [n.lower() for n in names]]
    return docs.withColumn(key, run(F.col(text_col))).select(*keep, F.col(f"{key}.lang").alias(names[0]), F.col(f"{key}.score").alias(names[1]), F.col(f"{key}.shares").alias(names[2]))
