"""Operator 1: toxicity by a weighted finite-state pattern grammar.

Words and marks become tags (insult, threat, target, will, negation, report; quotation
mark, break, end) by a lexicon. Five small transducers read the tags of a paragraph: insult
and threat say what is there, target whether it is aimed at someone, negation and report
whether it is denied or somebody else's words (up to the end of the sentence, or of the
quotation that a report opens). Their product, composed once, reads a paragraph in one pass
and gives each insult or threat a pattern: alone, aimed, negated, reported. A pattern's
weight times the word's own weight is evidence x; a text's score is 1 - exp(-sum of x), the
chance that a clause at least is toxic. A word that stands alone never reaches 0.5 by itself.

The insult lexicon is learned: words and word beginnings that mark labelled toxic texts, on
at most `fit_rows` labelled rows, chosen by a hash of doc_id, of which texts that share the
two least hashes of their longer words (copies and near copies) count once. A learned word
never takes the place of a tagged one of the grammar. The patterns' weights are fitted on
the same rows, between bounds, and drawn towards their first values where few rows show a
pattern.

Null, empty and wordless texts get the prior score. Very long texts are read whole. Equal
doc_ids keep a row each; without doc_id, held_out is null. Without usable labels only the
fixed lexicon and weights work. Other columns are left out.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Labelled rows that lexicon and weights are fitted on, at most.
FIT_ROWS = 12_000
#: Lengths of the word beginnings that are learned besides whole words.
STEMS = (4, 5, 6)
PRIOR = 0.01

# Tagged words of the grammar, for English, French, German and Spanish.
FIXED_WORDS = {
    "insult": "idiot idiots moron morons imbecile stupid pathetic worthless loser scum imbécile dumbass arschloch pendejo connard",
    "threat": "kill hurt destroy beat stab shoot tuer frapper töten schlagen matar golpear",
    "target": "you your youre they them he she those these tu vous toi du dich ihr sie usted ustedes ellos",
    "will": "will shall gonna must ll vais va werde wird voy vamos",
    "negation": "not never isnt arent dont wasnt nor pas jamais nicht kein keine niemals nunca jamás tampoco",
    "report": "said says wrote claims claimed alleged reportedly quoted dit selon sagte laut dijo según",
}
#: Marks: quotation marks, breaks within a sentence, ends of sentences.
MARKS = {"quote": "\"“”„«»", "break": ",;:()", "end": ".!?"}
TAGS = ("other", *FIXED_WORDS, *MARKS)
_TAG = {x: n for n, x in enumerate(TAGS)}
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»,;:().!?]")
#: Patterns: the weight to begin with, and the bounds of a fitted one.
PATTERNS = {
    "insult alone": (0.5, 0.4, 0.62), "insult aimed": (1.0, 0.8, 1.6), "insult negated": (0.12, 0.02, 0.3), "insult reported": (0.25, 0.05, 0.4), "aimed later": (0.45, 0.3, 0.8),
    "threat alone": (0.03, 0.0, 0.1), "threat aimed": (0.9, 0.75, 1.5), "threat willed": (1.6, 1.2, 2.5), "threat negated": (0.1, 0.02, 0.3), "threat reported": (0.25, 0.05, 0.4),
}
_PATTERN = {x: n for n, x in enumerate(PATTERNS)}
FIRST_WEIGHTS = [x[0] for x in PATTERNS.values()]


class Transducer:
    """arcs: (state, tag) -> (next state, what it says). A missing arc goes to `default[state]` and says nothing."""

    def __init__(self, arcs: dict, default: dict[int, int] | None = None):
        self.arcs, self.default = arcs, default or {}

    def step(self, state: int, tag: str) -> tuple[int, str]:
        return self.arcs.get((state, tag), (self.default.get(state, state), ""))


def _window(n: int, opens: str, says: dict[str, str], closes: tuple[str, ...]) -> Transducer:
    """After the tag `opens`, for the next n tags: says[tag] at a tag. Tags in `closes` end it."""
    arcs = {(s, tag): (max(0, s - 1), x) for tag, x in says.items() for s in range(1, n + 1)}
    arcs |= {(s, opens): (n, says.get(opens, "") if s else "") for s in range(n + 1)} | {(s, tag): (0, "") for tag in closes for s in range(1, n + 1)}
    return Transducer(arcs, {s: s - 1 for s in range(1, n + 1)})


_ENDS = ("break", "end")
#: An insult, and a target within the next three tags.
INSULT = Transducer({**{(s, "insult"): (3, "insult") for s in range(4)}, **{(s, "target"): (0, "later") for s in (1, 2, 3)}, **{(s, "end"): (0, "") for s in (1, 2, 3)}}, {3: 2, 2: 1, 1: 0})
#: 0 nothing, 1 after will, 2 after a threat, 3 after both: a threat counts once there is a target.
THREAT = Transducer({(0, "will"): (1, ""), (0, "threat"): (2, "threat"), (1, "threat"): (3, "threat"), (2, "threat"): (2, "threat"), (3, "threat"): (3, "threat"), (2, "target"): (0, "aimed"), (3, "target"): (0, "willed"), **{(s, x): (0, "") for s in (1, 2, 3) for x in _ENDS}})
TARGET = _window(4, "target", {"insult": "at"}, ("end",))
NEGATION = _window(4, "negation", {"insult": "negated", "threat": "negated", "target": "negated"}, _ENDS)
#: 0 nothing, 1 from a report to the end of its sentence, 2 in a quotation that follows a report, over all its sentences.
REPORT = Transducer({(0, "report"): (1, ""), (1, "quote"): (2, ""), (1, "end"): (0, ""), (2, "quote"): (0, ""), **{(s, x): (s, "reported") for s in (1, 2) for x in ("insult", "threat", "target")}})
PARTS = (INSULT, THREAT, TARGET, NEGATION, REPORT)


def patterns(said: set[str]) -> tuple[int, ...]:
    """Numbers of the patterns that the transducers' words at one tag amount to."""
    denied = next((x for x in ("negated", "reported") if x in said), "")
    out = []
    if "insult" in said:
        out.append("insult " + (denied or ("aimed" if "at" in said else "alone")))
    if "later" in said and not denied:
        out.append("aimed later")
    if "threat" in said:
        out.append("threat alone")
    for x in ("aimed", "willed"):
        if x in said:
            out.append(f"threat {denied or x}")
    return tuple(_PATTERN[x] for x in out)


def compose(*parts: Transducer) -> list[list[tuple[int, tuple[int, ...]]]]:
    """The parts' product: of each reachable state and tag, the next state and the patterns that it gives."""
    numbers, arcs, todo = {(0,) * len(parts): 0}, {}, [(0,) * len(parts)]
    while todo:
        at = todo.pop()
        for tag in TAGS:
            steps = [p.step(s, tag) for p, s in zip(parts, at, strict=True)]
            to = tuple(x[0] for x in steps)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            arcs[numbers[at], _TAG[tag]] = (numbers[to], patterns({x[1] for x in steps}))
    return [[arcs[s, t] for t in range(len(TAGS))] for s in range(len(numbers))]


GRAMMAR = compose(*PARTS)


def spelled(text: str | None) -> str:
    """Lower case, with contracted negations as words of their own."""
    low = (text or "").lower().replace("’", "'")
    return low.replace("n't", " not") if "n't" in low else low


class Scorer:
    """words, stems: learned insult weights by word, and by the first letters of a word. weights: of the patterns."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: list[float] = FIRST_WEIGHTS):
        self.tags = {w: (_TAG["insult"], x) for w, x in words.items()}
        fixed = {w: (_TAG[t], 1.0) for t, ws in FIXED_WORDS.items() for w in ws.split()}
        self.tags |= {w: x if TAGS[x[0]] != "insult" else (x[0], max(0.9, words.get(w, 0.0))) for w, x in fixed.items()}
        self.tags |= {m: (_TAG[t], 1.0) for t, ms in MARKS.items() for m in ms}
        self.stems = {n: {s: x for s, x in stems.items() if len(s) == n} for n in STEMS}
        self.marks = {w for w, (t, _) in self.tags.items() if TAGS[t] in ("insult", "threat")}
        self.weights = list(weights)

    def stem_weight(self, word: str) -> float:
        return max(known.get(word[:n], 0.0) if len(word) >= n else 0.0 for n, known in self.stems.items())

    def tag(self, word: str) -> tuple[int, float]:
        if found := self.tags.get(word):
            return found if TAGS[found[0]] != "insult" else (found[0], max(found[1], self.stem_weight(word)))
        weight = self.stem_weight(word)
        return (_TAG["insult"], weight) if weight else (0, 0.0)

    def marked(self, words: set[str]) -> set[str]:
        """Words that put out weight; paragraphs without any need no reading."""
        found = words & self.marks
        for n, known in self.stems.items():
            if known:
                found |= {w for w in words if w[:n] in known}
        return found

    def evidence(self, text: str | None) -> list[float]:
        """Of each pattern, the sum of the own weights of what shows it."""
        found, low = [0.0] * len(PATTERNS), spelled(text)
        marked = self.marked(set(_WORD.findall(low)))
        if marked:
            for paragraph in low.split("\n"):
                tokens = _TOKEN.findall(paragraph)
                if marked.isdisjoint(tokens):
                    continue
                state = 0
                for token in tokens:
                    tag, own = self.tag(token)
                    state, shown = GRAMMAR[state][tag]
                    for x in shown:
                        found[x] += own
        return found

    def score(self, text: str | None) -> float:
        return 1.0 - (1.0 - PRIOR) * math.exp(-sum(w * x for w, x in zip(self.weights, self.evidence(text), strict=True)))


def fitted_weights(evidence: np.ndarray, toxic: np.ndarray, steps: int = 300) -> list[float]:
    """Weights between their bounds that make the labels likeliest, less their squared distance from the first ones (a concave function), by projected ascent."""
    first, low, high = np.array(list(PATTERNS.values())).T
    bad, good, w = evidence[toxic == 1], evidence[toxic == 0], first.copy()
    steep = 1.0 / (1.0 + len(toxic))
    for n in range(steps):
        clean = (1 - PRIOR) * np.exp(-bad @ w)
        slope = bad.T @ (clean / np.maximum(1e-9, 1 - clean)) - good.sum(axis=0) - 20 * (w - first)
        w = np.clip(w + steep * slope / (1 + n / 50), low, high)
    return w.tolist()


def labelled_texts(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, toxic) of at most `fit_rows` labelled rows that are not held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isin(0, 1) & (held_out("doc_id") == F.lit(False)))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        sketch, texts = [], []
        for value in batch.column("text"):
            words = set(_WORD.findall(spelled(value.as_py())))
            least = sorted(xxhash.xxh64_intdigest(w) for w in words if len(w) > 5)[:2]
            sketch.append(" ".join(map(str, least)) or " ".join(sorted(words)))
            texts.append(sorted(words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sketch, pa.string()), batch.column("toxic"), pa.array(texts, pa.list_(pa.string()))], ["doc_id", "sketch", "toxic", "features"])

    rows = written(labelled_texts(docs, labels, fit_rows), "labelled")
    seen = arrow_map(rows, features, "doc_id long, sketch string, toxic int, features array<string>")
    one = seen.groupBy("sketch", "toxic").agg(F.min_by("features", "doc_id").alias("features"))
    counted = one.select("toxic", F.explode(F.concat("features", F.array(F.lit("*")))).alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    # "*" stands in every text: its row has the totals. What the fitted rows can hold bounds the lexicon.
    counted = written(counted.where((F.col("feature") == "*") | (F.col("bad") >= 5) & (F.col("good") * 9 <= F.col("bad"))), "features")
    total = counted.where("feature = '*'").first()
    words, stems = {}, {}
    if total and total.bad:
        for r in counted.where((F.col("feature") != "*") & (F.col("bad") >= 0.008 * total.bad)).collect():
            # One clean text more than was seen, so that a mark seen a few times counts for little.
            odds = math.log(r.bad / total.bad) - math.log((r.good + 1) / (total.good + 1))
            if odds >= 3:
                (stems if r.feature[-1] == "*" else words)[r.feature.rstrip("*")] = min(1.0, ((odds - 2) / 2.5) ** 1.5)
    scorer = Scorer(words, stems)

    def shown(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([scorer.evidence(x.as_py()) for x in batch.column("text")], pa.list_(pa.float64()))], ["toxic", "evidence"])

    # A few numbers for each of at most `fit_rows` rows.
    found = arrow_map(rows.select("toxic", "text"), shown, "toxic int, evidence array<double>").collect()
    if found:
        scorer.weights = fitted_weights(np.array([r.evidence for r in found]), np.array([r.toxic for r in found]))
    return scorer


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted for every text."""

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([scorer.score(x.as_py()) for x in batch.column("text")], pa.float64())], ["doc_id", "score"])

    made = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), over, "doc_id long, score double")
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    return score_documents(docs, fit(docs, labels))
