"""Toxicity by a learned lexicon, matched through Levenshtein automata, and scored in its context.

Learning, from labelled rows alone: of at most SAMPLE labelled documents (those of least hash, a documented bound), words
and word beginnings that the toxic ones hold far more often than the others make the lexicon, however many; of near copies one
counts. Of beginnings that say the same the longest is taken. Words that clean documents of the sample hold are no misspellings, however near they come.

Matching: the lexicon's words, and the words of toxic documents of the sample that its beginnings cover, are a trie; its
product with Levenshtein automata (one edit for terms of 4 letters on, two from 9 on, and for a covered word as for its
beginning; a swap of neighbours is one edit) is made deterministic step by step as texts need it, so that a word is read
once, letter by letter, and most words end after two or three. Beginnings themselves are matched exactly: a word that
begins so counts as spelt as learned.

Scoring: each hit has a weight, full if spelt as learned, less if misspelt. Its window, WINDOW words to either side, tells
quotation from abuse: a hit between quotation marks weighs QUOTED as much, and less still by a reporting word nearby. The
score is 1 - exp(-sum of weights), over the whole text, and says nothing of language, source or label.

Defined results: null and empty texts score 0; null labels are left out, and of repeated labels the highest counts; with no
labels nothing is learned and all scores are 0; repeated rows are scored alike; a null id is never held out; other columns
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.llm.common import saved, table
from lakevault.llm.ngram_join import joined
from lakevault.llm.shingles import chunks

#: Labelled documents that the lexicon is learned from, at most.
SAMPLE = 20_000
#: A term's least log-likelihood ratio, the least part of the documents with it that are toxic, and the most that one hit may score.
EVIDENCE, PRECISION, SURE = 12.0, 0.6, 0.95
SHORTEST, LONGEST = 3, 12
#: Words or features that a task holds at a time.
HELD = 100_000
WINDOW, QUOTED, REPORTED = 8, 0.2, 0.5
MISSPELT = 0.35
TOXIC = 0.7
OPENING, CLOSING = "\"'“„«‘‹»”", "\"'”“»’›«"
#: Words that introduce what others said (fixed values).
REPORTING = frozenset("said says wrote writes called calling quoted quote quotes word words term dit écrit cité dijo escribió citó sagte schrieb zitierte".split())


def bare(token: str) -> str:
    """A token in lower case, without marks at its ends."""
    token = token.lower()
    if not token.isascii():
        token = unicodedata.normalize("NFC", token)
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def features(text: str) -> set[str]:
    """A text's words, and their beginnings with a star."""
    words = {w for t in set(text.split()) if len(w := bare(t)) >= SHORTEST}
    return words | {f"{w[:k]}*" for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}


class Trie:
    def __init__(self, words: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for w in words:
            at = 0
            for c in w:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                at = self.next[at][c]
            self.word[at] = w


class Automaton:
    """The Levenshtein automata of all words of a trie, within some edits, as one deterministic automaton made as needed.

    A state is a set of (node, edits, swapped letter still to come or ""); letters that no word has are all alike.
    """

    def __init__(self, words: Iterable[str], edits: int):
        self.trie, self.edits = Trie(words), edits
        self.letters = {c for x in self.trie.next for c in x}
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.best: list[tuple[int, str] | None] = []
        self.start = self.known(self.closed({(0, 0, "")}))

    def closed(self, items: set) -> frozenset:
        """With what follows by leaving letters out."""
        todo, all_ = list(items), set(items)
        while todo:
            node, e, swap = todo.pop()
            if not swap and e < self.edits:
                for child in self.trie.next[node].values():
                    if (x := (child, e + 1, "")) not in all_:
                        all_.add(x)
                        todo.append(x)
        least: dict[tuple, int] = {}
        for node, e, swap in all_:
            least[node, swap] = min(e, least.get((node, swap), e))
        return frozenset((node, e, swap) for (node, swap), e in least.items())

    def known(self, state: frozenset) -> int:
        if not state:
            return -1
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.best.append(min(((e, self.trie.word[n]) for n, e, swap in state if not swap and self.trie.word[n] is not None), default=None))
        return self.ids[state]

    def step(self, at: int, letter: str) -> int:
        out, next_ = set(), self.trie.next
        for node, e, swap in self.states[at]:
            if swap:
                if swap == letter:
                    out.add((node, e, ""))
                continue
            if letter in next_[node]:
                out.add((next_[node][letter], e, ""))
            if e < self.edits:
                out.add((node, e + 1, ""))
                for c, child in next_[node].items():
                    out.add((child, e + 1, ""))
                    if c != letter and letter in next_[child]:
                        out.add((next_[child][letter], e + 1, c))
        return self.known(self.closed(out))

    def match(self, word: str) -> tuple[int, str] | None:
        """Edits and word of the nearest match of a whole word, or None."""
        at = self.start
        for c in word:
            if c not in self.letters:
                c = ""
            to = self.steps.get((at, c))
            if to is None:
                to = self.steps[at, c] = self.step(at, c)
            if to < 0:
                return None
            at = to
        return self.best[at]


class Lexicon:
    """Weights of terms; a term with a star is a beginning. innocent: words that are no misspellings; covered: words that beginnings cover, whose misspellings count."""

    def __init__(self, terms: dict[str, float], innocent: Iterable[str] = (), covered: Iterable[str] = ()):
        self.terms, self.innocent = terms, frozenset(innocent)
        self.words = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.beginnings = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.lengths = sorted({len(b) for b in self.beginnings})
        under = {w: b for w in covered if w not in self.words and (b := self.begun(w))}
        self.spelt = self.words | {w: self.beginnings[b] for w, b in under.items()}
        self.sizes = {w: len(under.get(w, w)) for w in self.spelt}
        self.automata: list[Automaton] | None = None

    def ready(self) -> None:
        if self.automata is None:
            near = [w for w, n in self.sizes.items() if 4 <= n < 9], [w for w, n in self.sizes.items() if n >= 9]
            self.automata = [Automaton(ws, k) for ws, k in zip(near, (1, 2), strict=True) if ws]
            self.known: dict[str, float] = {}

    def weigh(self, token: str) -> float:
        """A token's weight, 0 for most."""
        if (w := self.known.get(token)) is None:
            if len(self.known) > HELD:
                self.known.clear()
            w = self.known[token] = self.judge(bare(token))
        return w

    def judge(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        if b := self.begun(word):
            return self.beginnings[b]
        if len(word) < SHORTEST or word in self.innocent:
            return 0.0
        return max((MISSPELT * self.spelt[m[1]] for a in self.automata if (m := a.match(word))), default=0.0)

    def begun(self, word: str) -> str:
        """The beginning that covers a word, "" for most."""
        for n in self.lengths:
            if n <= len(word) and word[:n] in self.beginnings:
                return word[:n]
        return ""

    def near(self, word: str) -> bool:
        """Whether a word that is no term would count as a misspelt one."""
        return len(word) >= SHORTEST and word not in self.words and not self.begun(word) and any(a.match(word) for a in self.automata)

    def score(self, text: str) -> tuple[float, int, int]:
        """Score, hits and quoted hits of a whole text."""
        tokens = text.split()
        weigh, total, hits, quoted = self.weigh, 0.0, 0, 0
        for i, t in enumerate(tokens):
            if w := weigh(t):
                hits += 1
                if self.is_quoted(tokens, i):
                    quoted += 1
                    w *= QUOTED
                    if any(bare(x) in REPORTING for x in tokens[max(0, i - WINDOW) : i + WINDOW + 1]):
                        w *= REPORTED
                total += w
        return 1.0 - math.exp(-total), hits, quoted

    @staticmethod
    def is_quoted(tokens: list[str], i: int) -> bool:
        """Whether the window has an opening mark at or before a place, and a closing one from there on."""
        for k in range(i, max(-1, i - WINDOW - 1), -1):
            t = tokens[k]
            if k < i and len(t) > 1 and t.rstrip(".,;:!?")[-1:] in CLOSING and t[0] not in OPENING:
                return False  # that quotation ended before
            if t[0] in OPENING:
                break
        else:
            return False
        return any(x.rstrip(".,;:!?")[-1:] in CLOSING and x.rstrip(".,;:!?") for x in tokens[i : i + WINDOW + 1] if len(x) > 1)


def evidence(p: int, q: int, toxic: int, clean: int) -> float:
    """The log-likelihood ratio of a feature in p of the toxic and q of the clean documents; 0 if it speaks for clean."""
    n = p + q
    rate = toxic / (toxic + clean)
    if p <= n * rate:
        return 0.0
    part = lambda k, r: k * math.log(k / (n * r)) if k else 0.0
    return part(p, rate) + part(q, 1 - rate)


def chosen(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The terms among features with their counts in toxic and clean documents, and their weights.

    The strongest evidence is taken first, and then nothing that begins as it does, or that it begins as. A weight is
    such that the score of one hit is the part of toxic documents among those with the term.
    """
    told = {f: x for f, (p, q) in counts.items() if p / (p + q) >= PRECISION and (x := evidence(p, q, toxic, clean)) >= EVIDENCE}
    out: dict[str, float] = {}
    taken: set[str] = set()  # beginnings of what is taken
    for f in sorted(told, key=lambda f: (-told[f], -len(f.rstrip("*")), f.endswith("*"), f)):
        stem = f.rstrip("*")
        if any(f"{stem[:k]}*" in out for k in range(SHORTEST, len(stem) + 1)) or (f.endswith("*") and stem in taken):
            continue
        p, q = counts[f]
        out[f] = -math.log(1 - min(SURE, p / (p + q + 1)))
        taken.update(stem[:k] for k in range(SHORTEST, len(stem) + 1))
    return out


COUNTS, SIDES = "feature string, n long", "feature string, p long, q long"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean documents (bad, text) of a task hold each feature."""
    p: Counter = Counter()
    q: Counter = Counter()

    def out() -> pa.RecordBatch:
        found = list(p.keys() | q.keys())
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([x[f] for f in found], pa.int64()) for x in (p, q))], names=["feature", "p", "q"])

    for batch, texts in chunks(batches):
        for bad, t in zip(batch.column(0).to_pylist(), texts, strict=True):
            (p if bad else q).update(features(t))
        if len(p) + len(q) > HELD:
            yield out()
            p.clear()
            q.clear()
    yield out()


def telling(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The features among counts (feature, p, q) that may be terms: those whose evidence falls short by rounding alone are let through."""
    rate, p, q, n = toxic / (toxic + clean), F.col("p"), F.col("q"), F.col("p") + F.col("q")
    found = p * F.log(p / (n * rate)) + F.when(q > 0, q * F.log(q / (n * (1 - rate)))).otherwise(0.0)
    return counts.where((p >= 3) & (p / n >= PRECISION) & (p > n * rate) & (found >= EVIDENCE - 1e-6))


def holding(lexicon, test: Callable[[Lexicon, str], bool]):
    """How many documents of a task hold each word that passes a test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Lexicon = lexicon.value
        x.ready()
        found: Counter = Counter()
        for _, texts in chunks(batches):
            for t in texts:
                found.update({w for token in set(t.split()) if test(x, w := bare(token))})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"])

    return run


def without_copies(rows: DataFrame) -> DataFrame:
    """One of each group of near copies, by the verified links of the n-gram join, with a like label, so that words of much copied texts are no evidence. rows: id, toxic, text of the sample."""
    groups = joined(rows.select(F.col("id").alias("doc_id"), "text")).select(F.col("doc_id").alias("id"), "group_id")
    least = rows.select("id", "toxic").join(groups, "id").groupBy("group_id", F.col("toxic") > 0).agg(F.min("id").alias("id"))
    return rows.join(least.select("id"), "id", "left_semi")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """The lexicon that labels (doc_id, toxic) of docs (doc_id, text) teach."""
    spark = docs.sparkSession
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # no more than sample rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("toxic", "text").where("text IS NOT NULL")
    rows = saved(without_copies(saved(rows.withColumn("id", F.monotonically_increasing_id()), "labelled")), "labelled")
    sizes = {t: n for t, n in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Lexicon({})
    counts = rows.select((F.col("toxic") > 0).alias("bad"), "text").mapInArrow(counted, SIDES).groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    terms = chosen({f: (p, q) for f, p, q in telling(counts, toxic, clean).collect()}, toxic, clean)
    first = spark.sparkContext.broadcast(Lexicon(terms))
    covered = [r[0] for r in rows.where("toxic > 0").select("text").mapInArrow(holding(first, lambda x, w: x.begun(w) != ""), COUNTS).select("feature").distinct().collect()]
    second = spark.sparkContext.broadcast(Lexicon(terms, covered=covered))
    innocent = rows.where("toxic <= 0").select("text").mapInArrow(holding(second, Lexicon.near), COUNTS).select("feature").distinct()
    return Lexicon(terms, [r[0] for r in innocent.collect()], covered)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_hits, n_quoted for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Lexicon = shared.value
        x.ready()
        for batch, texts in chunks(batches):
            got = [x.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64())))], names=["doc_id", "score", "n_hits", "n_quoted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_hits long, n_quoted long")


def kept(docs: DataFrame, lexicon: Lexicon, threshold: float = TOXIC) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Lexicon = shared.value
        x.ready()
        for batch, texts in chunks(batches):
            yield batch.filter(pa.array([x.score(t)[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """scored, by what labels that are not held out teach, and predicted."""
    lexicon = learn(docs, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    return scored(docs, lexicon).withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits", "n_quoted")
