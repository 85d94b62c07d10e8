"""Language spans: script ranges narrow the candidates of a word, Viterbi over word scores labels the words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import STEP_BYTES, released

BUCKETS_BITS = 16
#: Documents per language that the letter statistics are learned from (a documented bound; all their text is read).
TRAIN_DOCS = 4000
#: Natural-log cost of a change of language between two words.
SWITCH = 10.0
#: A language is no candidate for a word in a script that makes up less than this share of its letters.
SCRIPT_SHARE = 1e-3
UNKNOWN = "und"
#: A text may fit its language worse than all but this share of the texts learned from, by so many natural logs per letter.
WORST, SLACK = 1e-3, 0.5
#: Texts with fewer letters say nothing about how a language's texts fit.
FIT_LETTERS = 40

# First code points of script ranges, fixed values of the Unicode block layout; what lies before 0x370 counts as Latin.
_SCRIPTS = {
    "latin": 0x0000, "greek": 0x0370, "cyrillic": 0x0400, "armenian": 0x0530, "hebrew": 0x0590, "arabic": 0x0600,
    "indic": 0x0900, "southeast": 0x0E00, "georgian": 0x10A0, "hangul": 0x1100, "ethiopic": 0x1200, "khmer": 0x1780,
    "mongolian": 0x1800, "latin more": 0x1E00, "greek more": 0x1F00, "symbols": 0x2000, "kana": 0x3040, "bopomofo": 0x3100,
    "han": 0x3400, "yi": 0xA000, "other": 0xA490, "hangul syllables": 0xAC00, "forms": 0xD7B0, "beyond": 0x10000,
}
_SCRIPT_START = np.array(list(_SCRIPTS.values()))


@cache
def _letter() -> np.ndarray:
    """Whether a code point is a letter."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


@dataclass
class Model:
    languages: list[str]
    #: (buckets, languages) log probabilities of letter contexts.
    scores: np.ndarray
    #: (scripts, languages) whether a language is a candidate.
    scripts: np.ndarray
    #: Least mean log score per letter of texts of each language; -inf where nothing is known.
    floors: dict[str, float]


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one array of code points: letter places, their context buckets, word starts among letters, text of each letter."""
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter()[points]
    at = np.flatnonzero(letter)
    folded = np.where(letter, points, np.uint32(32))
    h = folded[at - 1] * np.uint32(0x9E3779B1) + folded[at] * np.uint32(0x85EBCA77) + folded[at + 1] * np.uint32(0xC2B2AE3D)
    bucket = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BUCKETS_BITS)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1]) if len(at) else at
    begins = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return at, bucket, first, np.searchsorted(begins, at, "right") - 1


def _script(points: np.ndarray) -> np.ndarray:
    return np.searchsorted(_SCRIPT_START, points, "right") - 1


def _groups(texts: list[str], limit: int) -> Iterator[np.ndarray]:
    """Row numbers, longest texts first, in runs of about ``limit`` characters."""
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield order[i:j]
        i = j


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Letter statistics per language of the rows of docs whose language is known.

    Of each language a share of rows is read, chosen by a hash of the text, about ``train_docs`` of them. Counts are summed
    in tasks; the driver gets one row per language and bucket.
    """
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BUCKETS_BITS, 0), np.float32), np.zeros((len(_SCRIPTS), 0), bool), {})
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    share: Column = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1_000_000, int(1_000_000 * train_docs / n) + 1))).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), pc.utf8_lower(batch.column(1)).to_pylist()
            for rows in _groups(texts, STEP_BYTES):
                for name in {langs[r] for r in rows}:
                    own = [texts[r] for r in rows if langs[r] == name]
                    at, bucket, _, _ = _letters(own)
                    points = np.frombuffer((" " + " ".join(own) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)[at]
                    buckets, scripts = seen.setdefault(name, (np.zeros(1 << BUCKETS_BITS, np.int64), np.zeros(len(_SCRIPTS), np.int64)))
                    buckets += np.bincount(bucket, minlength=len(buckets))
                    scripts += np.bincount(_script(points), minlength=len(scripts))
        for name, (buckets, scripts) in seen.items():
            both = np.r_[buckets, scripts]
            key = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key), pa.array(both[key])], names=["lang", "key", "n"])

    counted = known.filter(draw < share).mapInArrow(released(count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    table = np.zeros(((1 << BUCKETS_BITS) + len(_SCRIPTS), len(languages)))
    for r in counted.collect():
        table[r.key, languages.index(r.lang)] = r.n
    buckets, scripts = table[: 1 << BUCKETS_BITS], table[1 << BUCKETS_BITS :]
    rare = 0.05
    used = np.count_nonzero(buckets.any(axis=1)) + 1
    scores = np.log((buckets + rare) / (buckets.sum(axis=0) + rare * used)).astype(np.float32)
    model = Model(languages, scores, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1), {})
    # How the texts learned from fit their own language; a text adds little to the statistics that it is held against.
    own = identify(known.filter(draw < share), model, keep=["lang"]).filter((F.col("lang") == F.col("lang_pred")) & (F.col("letters") >= FIT_LETTERS))
    worst = own.groupBy("lang").agg(F.percentile_approx("fit", WORST, 10_000).alias("fit"))
    model.floors = {r.lang: r.fit - SLACK for r in worst.collect()}
    return model


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word. scores: (words, labels) of texts one after the other, sizes: words per text, falling.

    All texts step together; the texts still running are a prefix.
    """
    n_texts, n_labels = len(sizes), scores.shape[1]
    longest = int(sizes[0]) if n_texts else 0
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    running = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t words
    labels = np.zeros(len(scores), np.int64)
    came = np.zeros((len(scores), n_labels), bool)
    best = np.zeros(len(scores), np.int64)
    value = np.zeros((n_texts, n_labels))
    for t in range(longest):
        a = running[t]
        word = begin[:a] + t
        v = value[:a]
        if t:
            top = v.argmax(axis=1)
            best[word] = top
            jump = v[np.arange(a), top][:, None] - switch
            came[word] = jump > v
            v = np.maximum(v, jump)
        v = v + scores[word]
        value[:a] = v - v.max(axis=1, keepdims=True)
    state = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = running[t]
        word = begin[:a] + t
        labels[word] = state[:a]
        if t:
            state[:a] = np.where(came[word, state[:a]], best[word], state[:a])
    return labels


#: Columns that identify() adds.
FOUND = ("lang_pred", "score", "spans", "known", "fit", "letters")


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, switch: float = SWITCH) -> DataFrame:
    """Columns ``keep`` of docs and: lang_pred, score, spans (array of begin, end, lang in code points), known, fit, letters.

    lang_pred is the language that most letters are labelled with (of equal ones the first by name), score its share of all
    letters. known is the share of letters in a script that some language uses, fit the mean log score per letter of the
    labels. Null texts, texts without letters and every text under a model without languages give ``und``, 0, no spans, 0, 0 and 0.
    Columns of docs that are named like a new one are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in FOUND]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<begin:long,end:long,lang:string>>"

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m: Model = shared.value
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for column in batches:
            texts = pc.fill_null(column, "").to_pylist()
            lang, spans, told = [UNKNOWN] * len(texts), [[] for _ in texts], np.zeros((4, len(texts)))
            limit = max(1, STEP_BYTES * 4 // max(len(m.languages), 4))
            for rows in _groups(texts, limit) if m.languages else ():
                _label(m, [texts[r] for r in rows], rows, switch, lang, told, spans)
            score, known, fit, letters = told
            columns = [pa.array(lang, pa.string()), pa.array(score), pa.array(spans, kind), pa.array(known), pa.array(fit), pa.array(letters.astype(np.int64))]
            yield pa.StructArray.from_arrays(columns, names=list(FOUND))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(judged)(batches)

    # Only the text goes to the workers. Not called deterministic, since a filter on the columns would otherwise run it a second time.
    found = F.arrow_udf(run, f"lang_pred string, score double, spans {span}, known double, fit double, letters long").asNondeterministic()
    return docs.select(*keep, found(F.col(text_col).cast("string")).alias("__found")).select(*keep, *[f"__found.{c}" for c in FOUND])


def _label(m: Model, texts: list[str], rows: np.ndarray, switch: float, lang: list, told: np.ndarray, spans: list) -> None:
    n_labels = len(m.languages)
    # Lower-casing may change a text's length; spans then still count the code points of the text as it is.
    low = [t.lower() for t in texts]
    low = [a if len(a) == len(t) else "".join(c.lower()[:1] for c in t) for a, t in zip(low, texts, strict=True)]
    at, bucket, first, text = _letters(low)
    if not len(at):
        return
    points = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    words = np.add.reduceat(m.scores[bucket], first, axis=0)
    candidates = m.scripts[_script(points[at[first]])]
    usual = candidates.any(axis=1)
    words[~candidates & usual[:, None]] = -1e6
    owner = text[first]
    size = np.bincount(owner, minlength=len(texts))
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_size = np.argsort(place[owner], kind="stable")
    labels = np.empty(len(first), np.int64)
    labels[by_size] = viterbi(words[by_size], size[order], switch)
    letters = np.diff(np.r_[first, len(at)])
    share = np.bincount(owner * n_labels + labels, letters, minlength=len(texts) * n_labels).reshape(-1, n_labels)
    total = share.sum(axis=1)
    known = np.bincount(owner, letters * usual, minlength=len(texts))
    fit = np.bincount(owner, words[np.arange(len(words)), labels], minlength=len(texts))
    top = share.argmax(axis=1)
    begins = np.cumsum([1, *[len(t) + 1 for t in texts]])
    cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])])
    last = np.r_[cut[1:], len(first)] - 1
    from_, to = at[first[cut]] - begins[owner[cut]], at[np.r_[first[1:], len(at)][last] - 1] + 1 - begins[owner[cut]]
    for o, a, b, k in zip(owner[cut].tolist(), from_.tolist(), to.tolist(), labels[cut].tolist(), strict=True):
        spans[rows[o]].append({"begin": a, "end": b, "lang": m.languages[k]})
    for i, r in enumerate(rows):
        if total[i]:
            lang[r] = m.languages[top[i]]
            told[:, r] = share[i, top[i]] / total[i], known[i] / total[i], fit[i] / total[i], total[i]


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: crc32 of the id's text modulo 5 is 0, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
