"""Toxicity: a lexicon learned from labelled documents, met by Levenshtein automata on its trie, and the words around each hit.

The trie holds whole terms and open stems (any ending). All different words of a batch walk it together: a trie node keeps the words
whose automaton is still alive there and their band of edit distances. What surrounds a hit tells abuse from quotation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import mix64, random_words, released, stored

#: Labelled documents drawn of each class (a documented bound of what is learned from).
TRAIN_DOCS = 8000
#: Terms that would pass the test of the lexicon by chance, in the whole vocabulary.
CHANCE = 0.1
#: Least share of a term's contexts that lie in toxic documents.
PURITY = 0.8
#: Letters of an open stem at least, its endings at least, the most that one ending may make of it.
STEM, ENDINGS, LEAD = 4, 3, 0.8
#: Longest word that can be a term; more letters of a word are only looked at by their first.
LETTERS = 24
#: No single hit is surer than this before its surroundings are looked at.
SUREST = 0.95
#: A document is called toxic from this score on.
CUT = 0.7
STEP_CHARS = 1 << 20
#: Code points on either side of a hit that count as its surroundings.
AROUND = 120

# Digits and signs read as letters.
_READ_AS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_SIGNS = "@$*"
# Words that announce a quotation, words that address someone, quotation marks.
_REPORTING = set(
    "said says say saying wrote writes quote quoted quotes quoting called calls term word words phrase slur insult insults"
    " sagte sagt schrieb schreibt zitat zitiert nannte nennt wort begriff ausdruck beleidigung"
    " dit disait écrit écrivait cite citation appelle appelé mot terme injure insulte"
    " dijo dice escribió escribe cita citó llamó llama palabra término insulto".split()
)
_ADDRESS = set("you your yours youre u ur du dich dir dein deine ihr euch sie tu te toi ton ta vous votre usted tú ti vos tus su".split())
_QUOTES = "\"“”„«»‟"
_CUES = ("quoted", "reported", "addressed", "crowded", "shouted")
#: What the cues tell (log odds of abuse) before labels have a say, and how many contexts of labels that belief is worth.
_BELIEF, _WEIGHT = np.array([-2.0, -1.5, 0.7, 1.0, 0.3]), 4.0
#: Likewise for a document: 1, the odds of its likeliest hit, the logarithm of the number of its different likely ones.
_ODDS = np.array([0.0, 1.0, 0.5])

_LOW = np.arange(1 << 16, dtype=np.uint32)
for _i in range(1 << 16):
    _c = chr(_i).lower()
    if len(_c) == 1:
        _LOW[_i] = ord(_c)
for _c, _as in _READ_AS.items():
    _LOW[ord(_c)] = ord(_as)
_LOW[0xFFFF] = 0
_IN_WORD = np.array([chr(i).isalnum() for i in range(1 << 16)])
_IS_SIGN = np.zeros(1 << 16, bool)
_IS_SIGN[[ord(c) for c in _SIGNS]] = True
_PLACES = random_words(LETTERS, 71, odd=True)


def edits(letters: int, open_end: bool) -> int:
    """Edits within which a word is taken for a term of so many letters."""
    if open_end:
        return 0 if letters < 6 else 1
    return 0 if letters < 5 else 1 if letters < 8 else 2


class Node:
    """Trie node: children by code point, the terms that end here as (number, edits, open), the most edits of any term below."""

    def __init__(self) -> None:
        self.children: dict[int, Node] = {}
        self.ends: list[tuple[int, int, bool]] = []
        self.most = 0


def trie(terms: list[tuple[str, bool]]) -> Node:
    root = Node()
    for number, (text, open_end) in enumerate(terms):
        node, k = root, edits(len(text), open_end)
        node.most = max(node.most, k)
        for c in text:
            node = node.children.setdefault(ord(c), Node())
            node.most = max(node.most, k)
        node.ends.append((number, k, open_end))
    return root


def hits(words: np.ndarray, root: Node) -> list[tuple[int, int, int]]:
    """(row, term, distance) of the words (rows of code points, ended by 0) that are within a term's edits.

    Walks the trie once for all rows. Column j of a node's band is the distance of the node's letters to the first depth + j - K
    letters of the word; rows whose band exceeds the edits allowed below are dropped.
    """
    k = root.most
    lengths = (words != 0).sum(axis=1)
    padded = np.concatenate([words, np.zeros((len(words), k + 1), words.dtype)], axis=1)
    far = np.int8(100)
    band = np.full((len(words), 2 * k + 1), far, np.int8)
    for j in range(k, 2 * k + 1):
        band[:, j] = np.where(j - k <= lengths, j - k, far)
    out: list[tuple[int, int, int]] = []
    todo = [(root, 0, np.arange(len(words)), band)]
    while todo:
        node, depth, rows, band = todo.pop()
        for number, most, open_end in node.ends:
            if open_end:
                gap = band.min(axis=1)
            else:
                at = lengths[rows] - depth + k
                inside = (at >= 0) & (at <= 2 * k)
                gap = np.where(inside, band[np.arange(len(rows)), np.clip(at, 0, 2 * k)], far)
            found = np.flatnonzero(gap <= most)
            out += [(int(rows[i]), number, int(gap[i])) for i in found]
        for letter, child in node.children.items():
            new = np.full_like(band, far)
            for j in range(2 * k + 1):
                i = depth + 1 + j - k  # letters of the word
                if i < 0:
                    continue
                best = np.full(len(rows), far, np.int8)
                if i >= 1 and i <= padded.shape[1]:
                    best = band[:, j] + (padded[rows, i - 1] != letter)
                if j + 1 <= 2 * k:
                    best = np.minimum(best, band[:, j + 1] + 1)
                if j >= 1:
                    best = np.minimum(best, new[:, j - 1] + 1)
                new[:, j] = np.where(i <= lengths[rows], np.minimum(best, far), far)
            alive = new.min(axis=1) <= child.most
            if alive.any():
                todo.append((child, depth + 1, rows[alive], new[alive]))
    return out


class Words(NamedTuple):
    """Words of some texts: row of the text, places in it, hash of the word and of its neighbours, and different words as code points."""

    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    own: np.ndarray
    context: np.ndarray
    letters: np.ndarray
    distinct: np.ndarray


def _in_word(text: str, at: int) -> bool:
    return text[at].isalnum() or text[at] in _SIGNS


def _parts(texts: list[str | None]) -> Iterator[list[tuple[int, int, str, bool]]]:
    """Lists of (row, place, piece, whether its first word began before it) of about STEP_CHARS.

    A long text is cut between words; inside one only if it has thousands of letters, which no term has.
    """
    held, size = [], 0
    for row, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            end = min(len(text), at + STEP_CHARS)
            stop = min(len(text), end + 4096)
            while end < stop and _in_word(text, end):
                end += 1
            held.append((row, at, text[at:end], at > 0 and _in_word(text, at - 1) and _in_word(text, at)))
            size += end - at
            at = end
            if size >= STEP_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def words_of(parts: list[tuple[int, int, str, bool]]) -> Words:
    joined = "\n".join(p[2] for p in parts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.minimum(code, 0xFFFF)
    solid = _IN_WORD[code]
    sign = _IS_SIGN[code]
    if sign.any():  # signs count between letters only
        inner = np.zeros(len(code), bool)
        inner[1:-1] = sign[1:-1] & solid[:-2] & solid[2:]
        solid = solid | inner
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.array([len(p[2]) + 1 for p in parts])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    part = np.searchsorted(first, starts, "right") - 1
    begun = np.array([p[3] for p in parts])
    fresh = ~(begun[part] & (starts == first[part]))
    starts, ends, part = starts[fresh], ends[fresh], part[fresh]
    low = _LOW[code]
    at = starts[:, None] + np.arange(LETTERS)
    letters = np.where(at < ends[:, None], low[np.minimum(at, max(len(low) - 1, 0))], 0).astype(np.uint32) if len(starts) else np.zeros((0, LETTERS), np.uint32)
    own = mix64((letters.astype(np.uint64) * _PLACES).sum(axis=1, dtype=np.uint64))
    row = np.array([p[0] for p in parts])[part]
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same = row[1:] == row[:-1]
        before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    context = mix64(before * np.uint64(3) + mix64(after)).view(np.int64)
    shift = np.array([p[1] for p in parts]) - first
    _, distinct = np.unique(own, return_index=True)
    return Words(row, starts + shift[part], ends + shift[part], own, context, letters, distinct)


def _strings(letters: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(letters.astype("<u4")).view(f"<U{LETTERS}").ravel()


class Hit(NamedTuple):
    row: int
    begin: int
    end: int
    term: int
    distance: int
    surface: str
    cues: int
    context: int


def _cues(text: str, begin: int, end: int, crowded: bool) -> int:
    """Bits of the cues around text[begin:end]; quotation marks count on the line of the hit only."""
    left, right = text[max(0, begin - AROUND) : begin], text[end : end + AROUND]
    line_left, line_right = left.rpartition("\n")[2], right.partition("\n")[0]
    opened = sum(line_left.count(q) for q in _QUOTES) % 2 == 1 and any(q in line_right for q in _QUOTES)
    near_left, near_right = re.findall(r"\w+", left.lower())[-6:], re.findall(r"\w+", right.lower())[:6]
    sentence = re.split(r"[.?\n]", right, maxsplit=1)[0]
    found = (opened, bool(_REPORTING.intersection(near_left)), bool(_ADDRESS.intersection(near_left + near_right)), crowded, "!" in sentence)
    return sum(1 << i for i, x in enumerate(found) if x)


def found_in(texts: list[str | None], root: Node) -> Iterator[Hit]:
    """All hits of the texts; a word counts for the nearest term, of equally near ones for the first."""
    for parts in _parts(texts):
        words = words_of(parts)
        best: dict[int, tuple[tuple, int, int]] = {}
        for i, term, gap in hits(words.letters[words.distinct], root):
            rank = (-gap, -term)
            at = int(words.distinct[i])
            if at not in best or rank > best[at][0]:
                best[at] = (rank, term, gap)
        if not best:
            continue
        known = {int(words.own[at]): (term, gap) for at, (_, term, gap) in best.items()}
        places = np.flatnonzero(np.isin(words.own, np.array(list(known), np.uint64)))
        names = _strings(words.letters[places])
        for n, at in enumerate(places):
            term, gap = known[int(words.own[at])]
            row, begin, end = int(words.row[at]), int(words.begin[at]), int(words.end[at])
            beside = [m for m in (n - 1, n + 1) if 0 <= m < len(places) and int(words.row[places[m]]) == row and abs(int(words.begin[places[m]]) - begin) <= AROUND]
            yield Hit(row, begin, end, term, gap, str(names[n]), _cues(texts[row] or "", begin, end, bool(beside)), int(words.context[at]))


class Model(NamedTuple):
    """What is learned.

    terms: (text, open). spellings: toxic and clean contexts of a spelling. distances: how sure any other spelling of a term at a
    distance is. cues: log odds of the cues. documents: weights of 1, the odds of the likeliest hit and the logarithm of the number
    of different likely ones. base: score without a hit.
    """

    terms: list[tuple[str, bool]]
    spellings: dict[str, tuple[int, int]]
    distances: dict[tuple[int, int], float]
    cues: np.ndarray
    documents: np.ndarray
    base: float


def _told(n_toxic: str, n_clean: str, rate: float, tests: float):
    """Whether so many toxic and clean contexts are evidence: pure, and by Hoeffding's inequality not expected once in CHANCE tries."""
    k, m = F.col(n_toxic).cast("double"), (F.col(n_toxic) + F.col(n_clean)).cast("double")
    share = k / m
    apart = share * F.log2(share / rate) + F.when(share < 1, (1 - share) * F.log2((1 - share) / (1 - rate))).otherwise(0.0)
    return (share >= PURITY) & (share > rate) & (m * apart >= math.log2(max(tests, 1.0) / CHANCE))


def lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    """Terms and open stems that labelled texts (text, toxic) tell apart.

    Counts are of different contexts, a word's two neighbours, so copies of a document are no further evidence. A stem counts if
    several words share it and none of them makes up most of it; it is extended as far as all of them agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for parts in _parts(batch.column(0).to_pylist()):
                w = words_of(parts)
                short = np.flatnonzero(w.letters[:, -1] == 0)
                label = toxic[w.row[short]].astype(np.int64)
                _, one = np.unique(mix64(w.own[short] + mix64(w.context[short].view(np.uint64)) * np.uint64(5) + label.astype(np.uint64)), return_index=True)
                take = short[one]
                yield pa.RecordBatch.from_arrays([pa.array(_strings(w.letters[take]), pa.string()), pa.array(w.context[take]), pa.array(label[one], pa.int64())], names=["word", "context", "toxic"])

    seen = sample.select("text", "toxic").mapInArrow(released(run), "word string, context long, toxic long").distinct()
    counted = stored(seen.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("toxic") == 0).alias("n_clean")))
    v, n_toxic, n_clean = counted.agg(F.count("*"), F.sum("n_toxic"), F.sum("n_clean")).first()
    if not n_toxic or not n_clean:
        return []
    rate = n_toxic / (n_toxic + n_clean)
    enough = F.length("word") >= STEM
    whole = [r.word for r in counted.filter(enough & F.col("word").rlike(r"\p{L}") & _told("n_toxic", "n_clean", rate, v)).select("word").collect()]
    heads = F.transform(F.sequence(F.lit(STEM), F.least(F.length("word"), F.lit(LETTERS))), lambda k: F.substring("word", F.lit(1), k))
    stems = counted.filter(enough).select(F.explode(heads).alias("stem"), "n_toxic", "n_clean")
    stems = stems.groupBy("stem").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"), F.count("*").alias("endings"), F.max("n_toxic").alias("lead"))
    good = stems.filter((F.col("endings") >= ENDINGS) & (F.col("lead") <= LEAD * F.col("n_toxic")) & _told("n_toxic", "n_clean", rate, v))
    rows = sorted(((r.stem, (r.n_toxic, r.n_clean, r.endings)) for r in good.collect()), key=lambda x: (len(x[0]), x[0]))
    chosen: list[tuple[str, tuple]] = []
    for stem, counts in rows:
        parent = next((i for i, (s, _) in enumerate(chosen) if stem.startswith(s)), None)
        if parent is None:
            chosen.append((stem, counts))
        elif chosen[parent][1] == counts:
            chosen[parent] = (stem, counts)  # all words go on alike
    heads = [s for s, _ in chosen]
    return [(s, True) for s in heads] + sorted((w, False) for w in whole if not any(w.startswith(s) for s in heads))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _bits(cues: int) -> np.ndarray:
    return np.array([cues >> i & 1 for i in range(len(_CUES))], float)


def _fitted(belief: np.ndarray, x: np.ndarray, offset: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, pulled to a belief that counts as much as _WEIGHT rows; Newton steps."""
    weights = belief.copy()
    for _ in range(50):
        p = _sigmoid(offset + x @ weights)
        grad = _WEIGHT * (belief - weights) + x.T @ (toxic - p)
        curve = _WEIGHT * np.eye(len(belief)) + (x * (p * (1 - p))[:, None]).T @ x
        step = np.clip(np.linalg.solve(curve, grad), -1, 1)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _sure(model: Model, surface: str, term: int, distance: int, without: int | None = None) -> float:
    """How sure a hit is; without: the label of the context that is to be left out of the count."""
    n_toxic, n_clean = model.spellings.get(surface, (0, 0))
    n_toxic, n_clean = n_toxic - (without == 1), n_clean - (without == 0)
    return min(SUREST, (n_toxic + 4 * model.distances[term, distance]) / (n_toxic + n_clean + 4))


def _of_document(odds: list[float], surfaces: list[str]) -> list[float]:
    likely = {s for o, s in zip(odds, surfaces, strict=True) if o > 0}
    return [1.0, max(odds), math.log(max(1, len(likely)))]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """Lexicon and weights from about ``train_docs`` labelled documents of each class, drawn by a hash of their id.

    Labels other than 0 and 1, and null ids, are left out. Without documents of both classes nothing is toxic.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("toxic")).distinct()
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model([], {}, {}, _BELIEF, _ODDS, 0.0)
    share = F.lit(0)
    for toxic, n in sizes.items():
        share = F.when(F.col("toxic") == toxic, F.lit(min(1_000_000, int(1_000_000 * train_docs / n) + 1))).otherwise(share)
    drawn = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
    # Bounded by train_docs per class, so it may be sent to every task.
    sample = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("text", "toxic"))
    terms = lexicon(sample)
    root = trie(terms)

    kind = pa.list_(pa.struct([("surface", pa.string()), ("term", pa.int64()), ("distance", pa.int64()), ("cues", pa.int64()), ("context", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            told: list[list[dict]] = [[] for _ in texts]
            for h in found_in(texts, root):
                told[h.row].append({"surface": h.surface, "term": h.term, "distance": h.distance, "cues": h.cues, "context": h.context})
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(told, kind)], names=["toxic", "hits"])

    hit = "array<struct<surface:string,term:bigint,distance:bigint,cues:bigint,context:bigint>>"
    found = stored(sample.mapInArrow(released(run), f"toxic long, hits {hit}"))
    texts = {(r.hit, r.toxic): r.n for r in found.groupBy((F.size("hits") > 0).alias("hit"), "toxic").agg(F.count("*").alias("n")).collect()}
    rows = sorted((r.toxic, [tuple(h) for h in r.hits]) for r in found.filter(F.size("hits") > 0).distinct().collect())

    spelt: dict[str, list] = {}
    for surface, term, distance, toxic, _ in {(h[0], h[1], h[2], toxic, h[4]) for toxic, hits_ in rows for h in hits_}:
        spelt.setdefault(surface, [term, distance, 0, 0])[3 - toxic] += 1
    # Another spelling is like any of those seen at the same distance, each of which counts once, however frequent it is.
    shares: dict[tuple[int, int], list[float]] = {}
    for term, distance, n_toxic, n_clean in spelt.values():
        shares.setdefault((term, distance), []).append(n_toxic / (n_toxic + n_clean))
    distances = {}
    for term, (_, open_end) in enumerate(terms):
        for d in range(3):
            seen = sorted(shares.get((term, d), []))
            # Endings make any letters near a stem likely to be another word.
            prior = 0.9 if d == 0 else 0.5 if open_end else 0.9 * 0.9**d
            distances[term, d] = min(SUREST, (sum(seen) + 4 * prior) / (len(seen) + 4))
    # Back to the shares that the classes have among all labels.
    whole = {t: sizes[t] / max(1, texts.get((False, t), 0) + texts.get((True, t), 0)) for t in (0, 1)}
    missed, clear = texts.get((False, 1), 0) * whole[1], texts.get((False, 0), 0) * whole[0]
    base = min(0.5, (missed + 0.5) / (missed + clear + 1))
    model = Model(terms, {s: (v[2], v[3]) for s, v in spelt.items()}, distances, _BELIEF, _ODDS, base)
    if not rows:
        return model
    # A document's own contexts say nothing of it.
    each = [(toxic, h, _logit(_sure(model, *h[:3], without=toxic))) for toxic, hits_ in rows for h in hits_]
    x = np.array([_bits(h[3]) for _, h, _ in each])
    model = model._replace(cues=_fitted(_BELIEF, x, np.array([o for *_, o in each]), np.array([t for t, *_ in each], float)))
    odds = iter(np.array([o for *_, o in each]) + x @ model.cues)
    x = np.array([_of_document([next(odds) for _ in hits_], [h[0] for h in hits_]) for _, hits_ in rows])
    return model._replace(documents=_fitted(_ODDS, x, np.zeros(len(x)), np.array([t for t, _ in rows], float)))


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", detail: bool = False) -> DataFrame:
    """(keep..., score[, hits]) of every row; hits: term, begin, end (code points), distance and score of each, with ``detail``.

    The score weighs the likeliest hit and the number of different likely ones; without a hit, as in null and empty texts, it is the
    share of toxic labels among such texts.
    Repeated rows give equal rows, null ids are allowed, other columns are not read.
    """
    root = trie(model.terms)
    extra = ", hits array<struct<term:string,begin:int,end:int,distance:int,score:double>>" if detail else ""
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast((model, root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, root = shared.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            score, told = np.full(len(texts), model.base), [[] for _ in texts]
            for h in found_in(texts, root):
                odds = _logit(_sure(model, h.surface, h.term, h.distance)) + float(model.cues @ _bits(h.cues))
                told[h.row].append((h, odds))
            for row, own in enumerate(told):
                if own:
                    x = _of_document([odds for _, odds in own], [h.surface for h, _ in own])
                    score[row] = max(model.base, float(_sigmoid(model.documents @ np.array(x))))
            columns = [*batch.columns[: len(keep)], pa.array(score)]
            names = [*keep, "score"]
            if detail:
                kind = pa.list_(pa.struct([("term", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("distance", pa.int32()), ("score", pa.float64())]))
                hits_ = [[{"term": model.terms[h.term][0], "begin": h.begin, "end": h.end, "distance": h.distance, "score": float(_sigmoid(o))} for h, o in own] for own in told]
                columns.append(pa.array(hits_, kind))
                names.append("hits")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(released(run), f"{kinds}score double{extra}")
