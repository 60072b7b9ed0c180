"""Toxicity by a learnt lexicon, matched fuzzily, with context.

A trie of the lexicon is intersected with Levenshtein automata of its terms, one state set at a time, so that misspelled
terms are met in one pass over a word. The window around a match gives a context score, by which quotation and abuse part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .tokens import pieces, tidy

#: Labelled rows that a model is fitted on, about: beyond, rows are chosen by a hash of their id.
SAMPLE = 40_000
#: A term occurs in SUPPORT of the toxic rows and in 3 of them at least, which bounds the terms that are weighed: a row of
#: w words holds some 6 w terms, so there are no more than 6 w / SUPPORT of them.
SUPPORT = 0.005
#: Least share of toxic rows among those with a term; how many terms are to cover each toxic row; letters of a stem.
PURITY, COVER, STEMS = 0.85, 3, range(4, 9)
#: Words to each side of a match; rows that a context's prior weighs as much as.
WINDOW, PRIOR = 5, 50.0
#: Odds of abuse in quotation marks against those outside of them as long as no row shows them, and rows that this weighs as.
QUOTED, QUOTED_ROWS = 0.2, 8.0
#: Weight of a match with errors that no training row shows.
FUZZY = 0.6
#: A match with a lower chance than this is none.
LEAST = 0.45
QUOTES = "\"“”„«»‹›"
_KIND = {c: k for k, kind in enumerate(('"', "“”„", "«»", "‹›")) for c in kind}
EDGE = QUOTES + ".,;:!?'()[]{}…*$&%#|<>-_/`~"
KEEP, KEEP_STATES = 200_000, 50_000


def words_of(text: str) -> list[str]:
    return text.lower().split()


def terms_of(words: set[str]) -> set[str]:
    """What the lexicon is chosen from: whole words (`idiot$`) and stems (`idio`), the beginnings of longer words."""
    out = set()
    for w in words:
        w = w.strip(EDGE)
        if 3 <= len(w) <= 24:
            out.add(w + "$")
            out.update(w[:n] for n in STEMS if n < len(w))
    return out


def errors_for(term: str) -> int:
    """Edits (insertion, deletion, substitution, transposition) that a term allows."""
    n = len(term.rstrip("$"))
    return (0 if n < 5 else 1 if n < 9 else 2) if term.endswith("$") else (0 if n < 7 else 1)


class FuzzyTrie:
    """Levenshtein automata of all terms intersected with their trie, determinised as words ask for it."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.final: dict[int, list[tuple[int, int, bool]]] = {}  # node: (term, allowed errors, stem)
        self.most = [0]
        for t, term in enumerate(terms):
            node, allowed = 0, errors_for(term)
            self.most[0] = max(self.most[0], allowed)
            for c in term.rstrip("$"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.final.setdefault(node, []).append((t, allowed, not term.endswith("$")))
        self._reset()

    def _reset(self) -> None:
        self.sets: list[frozenset] = []
        self.index: dict[frozenset, int] = {}
        self.accept: list[tuple[int, int] | None] = []
        self.stem: list[tuple[int, int] | None] = []
        self.step: dict[tuple[int, str], int] = {}
        self.root = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        """items: (node, errors, letter that must come next to end a transposition)."""
        todo = list(items)
        while todo:  # a letter of the term is missing in the word
            node, e, need = todo.pop()
            if not need:
                for child in self.children[node].values():
                    x = (child, e + 1, "")
                    if e + 1 <= self.most[child] and x not in items:
                        items.add(x)
                        todo.append(x)
        key = frozenset(items)
        if key not in self.index:
            self.index[key] = len(self.sets)
            self.sets.append(key)
            ends = [(e, t, stem) for node, e, need in key if not need for t, allowed, stem in self.final.get(node, ()) if e <= allowed]
            best = min(ends, default=None)
            stems = min((x for x in ends if x[2]), default=None)
            self.accept.append(best and (best[1], best[0]))
            self.stem.append(stems and (stems[1], stems[0]))
        return self.index[key]

    def _next(self, state: int, c: str) -> int:
        out = set()
        for node, e, need in self.sets[state]:
            if need:
                if need == c:
                    out.add((node, e, ""))
                continue
            kids = self.children[node]
            if c in kids:
                out.add((kids[c], e, ""))
            if e < self.most[node]:
                out.add((node, e + 1, ""))  # a letter too many
                for a, child in kids.items():
                    if e + 1 <= self.most[child]:
                        if a != c:
                            out.add((child, e + 1, ""))
                        if c in self.children[child] and a != c and e + 1 <= self.most[self.children[child][c]]:
                            out.add((self.children[child][c], e + 1, a))
        return self._state(out) if out else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the closest term, or None. A stem matches the beginning of a word."""
        if len(self.sets) > KEEP_STATES:
            self._reset()
        state, best = self.root, None
        for c in word:
            key = (state, c)
            nxt = self.step.get(key)
            if nxt is None:
                nxt = self.step[key] = self._next(state, c)
            if nxt < 0:
                return best
            state = nxt
            if (s := self.stem[state]) is not None and (best is None or s[1] < best[1]):
                best = s
        end = self.accept[state]
        return end if end is not None and (best is None or end[1] < best[1]) else best


@dataclass
class Model:
    """terms with the share of toxic rows among those that hold them; fuzzy: that share for their misspelled matches;
    forms: (toxic, clean) rows of single misspelled forms; context: log odds of window words. Bounded by the fitting
    sample, so it is sent to the workers."""

    terms: list[str]
    purity: list[float]
    fuzzy: list[float] = field(default_factory=list)
    forms: dict[str, tuple[int, int]] = field(default_factory=dict)
    context: dict[str, float] = field(default_factory=dict)
    base: float = 0.02

    def __post_init__(self) -> None:
        self.trie, self.known = FuzzyTrie(self.terms), {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("trie", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def look_up(self, raw: str) -> tuple[float, int, str] | None:
        """(chance, term, form) of a word, None if it meets no term or hardly tells; form is empty for an exact match."""
        if raw in self.known:
            return self.known[raw]
        if len(self.known) >= KEEP:
            self.known.clear()
        word = raw.strip(EDGE)
        got, out = self.trie.match(word) if len(word) >= 3 else None, None
        if got:
            p, form = self.purity[got[0]], ""
            if got[1]:
                form = word if self.terms[got[0]].endswith("$") else word[: len(self.terms[got[0]])]
                t, n = self.forms.get(form, (0, 0))
                p = (t + 2 * (self.fuzzy[got[0]] if self.fuzzy else FUZZY * p)) / (t + n + 2)
            out = (p, got[0], form) if p >= LEAST or not self.fuzzy else None
        if len(raw) <= 40:
            self.known[raw] = out
        return out

    def hits(self, text: str) -> list[tuple[int, float, int, str]]:
        words = words_of(text)
        some = {w for w in set(words) if self.look_up(w)}
        return [(i, *self.look_up(w)) for i, w in enumerate(words) if w in some] if some else []

    def score(self, text: str | None) -> float:
        """Noisy-or over the terms that are met, each at its best match, shifted by that match's context."""
        best: dict[int, float] = {}
        words = inside = None
        for i, p, term, _ in self.hits(text or ""):
            words = words or words_of(text)
            inside = quoted(words) if inside is None else inside
            p = min(max(p, 1e-4), 1 - 1e-4)
            near = window(words, i, inside)
            known = [self.context[c] for c in near if c != QUOTES and c in self.context]
            shift = (sum(known) / len(known) if known else 0.0) + (self.context.get(QUOTES, 0.0) if QUOTES in near else 0.0)
            odds = math.log(p / (1 - p)) + max(-4.0, min(4.0, shift))
            best[term] = max(best.get(term, 0.0), 1 / (1 + math.exp(-odds)))
        keep = 1.0 - self.base
        for p in best.values():
            keep *= 1 - p
        return 1.0 - keep


def quoted(words: list[str]) -> bytearray:
    """Which words stand in quotation marks, however far apart the marks are. A mark before a word's letters opens, one
    after them closes what its kind has open; one that is never closed quotes nothing, and of two that open one kind the
    later counts."""
    out, begun = bytearray(len(words)), {}
    for i, word in enumerate(words):
        if not any(c in _KIND for c in word):
            continue
        letters = [k for k, c in enumerate(word) if c.isalnum()]
        for k, c in enumerate(word):
            if (kind := _KIND.get(c)) is None or letters and letters[0] < k < letters[-1]:
                continue
            opens = k < letters[0] if letters else kind not in begun
            if opens:
                begun[kind] = i
            elif kind in begun:
                at = begun.pop(kind)
                out[at : i + 1] = b"\1" * (i + 1 - at)
    return out


def window(words: list[str], i: int, inside: bytearray) -> set[str]:
    """The words around a match, and QUOTES for one that stands in quotation marks."""
    lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    out = {w.strip(EDGE) for w in words[lo:i] + words[i + 1 : hi]} - {""}
    if inside[i]:
        out.add(QUOTES)
    return out


def _count(df: DataFrame, of, kind: str = "term") -> DataFrame:
    """(kind..., t, n): in how many toxic and clean rows each item of of(text) stands; a batch sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n = Counter(), Counter()
            for part in pieces(batch, "text", 1 << 20):
                for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    (t if toxic else n).update(of(text or ""))
            every = list(t.keys() | n.keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([t[x] for x in every], pa.int64()), pa.array([n[x] for x in every], pa.int64())], [kind, "t", "n"])

    return df.select("toxic", "text").mapInArrow(run, f"{kind} string, t long, n long").groupBy(kind).agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About `sample` rows (id, toxic) of labels, all if there are no more, by a hash of the id; null labels are left out
    and of an id's labels the greatest counts. So few and narrow rows may be sent to all."""
    x = durable(labels.where(F.col("toxic").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic")))
    n = x.count()
    return x if n <= sample else x.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) < int((1 << 30) * (sample / n)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on the texts of docs (id, text) that a labelled_sample of labels (id, toxic) names.

    Terms are counted in the toxic rows, the frequent ones in the clean rows too, and of those that hardly occur in clean
    rows so many are taken, the one that adds most first, that each toxic row holds COVER of them if it can.
    """
    chosen = labelled_sample(labels, sample)
    rows = durable(docs.join(F.broadcast(chosen), "id").select("id", "text", (F.col("toxic") == 1).alias("toxic")))
    bad, good = rows.where("toxic"), rows.where(~F.col("toxic"))
    n_bad, n_good = bad.count(), good.count()
    if not n_bad:
        return Model([], [], base=0.02)
    often = _count(bad, lambda text: terms_of(set(words_of(text)))).where(F.col("t") >= max(3 if n_bad > 10 else 1, int(SUPPORT * n_bad)))
    found = {r["term"]: r["t"] for r in often.collect()}
    clean = {r["term"]: r["n"] for r in _count(good, lambda text: terms_of(set(words_of(text))) & found.keys()).collect()}
    rate = n_bad / (n_bad + n_good)
    purity = {x: (t + rate) / (t + clean.get(x, 0) + 1) for x, t in found.items()}
    pure = {x for x in found if purity[x] >= PURITY}

    def groups(text: str) -> str:
        """The pure terms of each word, a line a word."""
        return "\n".join(sorted({" ".join(sorted(terms_of({w}) & pure)) for w in words_of(text)} - {""}))

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([groups(x or "") for x in batch.column(0).to_pylist()], pa.string())], ["terms"])

    held = [[set(g.split(" ")) for g in r["terms"].split("\n")] for r in bad.select("text").mapInArrow(holds, "terms string").collect() if r["terms"]]
    model = Model(*_choose(held, purity))
    if not model.terms:
        return model

    def seen(text: str) -> set[str]:
        words, out, inside = words_of(text), set(), None
        for i, _, term, form in model.hits(text):
            inside = quoted(words) if inside is None else inside
            out.add("hit")
            if form:
                out.add(f"form {term} {form}")
            out.update("near " + w for w in window(words, i, inside))
        return out

    counts = {r["term"]: (r["t"], r["n"]) for r in _count(rows, seen).where((F.col("n") > 0) | (F.col("t") >= 10) | F.col("term").startswith("form ")).collect()}
    hit_t, hit_n = counts.get("hit", (0, 0))
    forms = [(*x.split(" ", 2)[1:], *c) for x, c in counts.items() if x.startswith("form ")]
    model.forms = {form: (t, n) for _, form, t, n in forms}
    # a form that no row shows is judged by its term's forms that few rows show
    rare = [[2 * FUZZY * p, 2.0] for p in model.purity]
    for term, _, t, n in forms:
        if t + n <= 2:
            rare[int(term)][0] += t
            rare[int(term)][1] += t + n
    model.fuzzy = [a / b for a, b in rare]
    def apart(t: int, m: int) -> float:
        """Log odds of what stands by t toxic and m clean matches."""
        share = (t + m) / (hit_t + hit_n)
        return math.log((t + PRIOR * share) / (hit_t + PRIOR)) - math.log((m + PRIOR * share) / (hit_n + PRIOR))

    model.context = {x[5:]: apart(t, m) for x, (t, m) in counts.items() if x.startswith("near ") and x[5:] != QUOTES and t + m >= 20}
    t, m = counts.get("near " + QUOTES, (0, 0))
    model.context[QUOTES] = (apart(t, m) if t + m else 0.0) + math.log(QUOTED) * QUOTED_ROWS / (QUOTED_ROWS + t + m)
    model.known.clear()
    return model


def _choose(held: list[list[set[str]]], purity: dict[str, float]) -> tuple[list[str], list[float]]:
    """Greedy cover: the term that adds most to rows covered fewer than COVER times; of equals the whole word, the longest.

    held: for each row the terms of each of its words. A chosen term settles the words that it matches and no others, so
    longer words and stems are weighed by the words that are left to them.
    """
    left_in: dict[str, Counter] = {}  # words of each row that a term would settle
    for i, row in enumerate(held):
        for g in row:
            for x in g:
                left_in.setdefault(x, Counter())[i] += 1
    least = max(2, int(SUPPORT * len(held)))
    need, unsettled, left, out = [COVER] * len(held), [list(row) for row in held], set(left_in), []
    while left:
        gain = {x: sum(1 for i in left_in[x] if need[i] > 0) for x in left}
        best = max(left, key=lambda x: (gain[x], x.endswith("$"), len(x), x))
        if gain[best] < least:
            break
        out.append(best)
        for i in list(left_in[best]):
            need[i] -= 1
            for g in [g for g in unsettled[i] if best in g]:
                unsettled[i].remove(g)
                for x in g:
                    left_in[x][i] -= 1
                    if not left_in[x][i]:
                        del left_in[x][i]
        left = {x for x in left if gain[x] >= least and x != best}
    return out, [purity[x] for x in out]


def score_rows(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(id, score): docs is (id, text); every whole text is scored, some MB at a time, a null like an empty one. Repeated rows
    are scored each; an empty table gives an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.score(x) for x in part.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return docs.select("id", F.col(text).alias("text")).mapInArrow(tidy(run), f"id {docs.schema['id'].dataType.simpleString()}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """The digest columns of the contract: doc_id, held_out, score, predicted.

    Only labels of rows that are not held out are learnt from. Null ids are not held out and have no label; repeated rows
    are scored each; without any label nothing is toxic and all scores are the base rate. Null and empty texts have a score
    too. Texts of any length are scored whole; an empty table gives an empty one; of terms that would add as much a whole
    word is taken, then the longest, then the last by name, so there are no ties; columns other than doc_id, text and toxic take no part, whatever their names.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    model = fit(texts, labels.where(~held).select(F.col("doc_id").alias("id"), "toxic"))
    scored = score_rows(texts, model)
    x = scored.withColumnRenamed("id", "doc_id")
    return x.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
