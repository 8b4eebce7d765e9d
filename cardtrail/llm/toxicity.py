"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps a word to a class (insult, threat, target, negation, report,
quote, other) and, for insults, a weight. Four small transducers read the classes of a
text: ``negation`` and ``report`` lower the weight of what follows, ``target`` raises
the weight of an insult in a clause with a person addressed, ``threat`` gives a weight to
a threat aimed at a target, or foretold of one (you will be killed). Their composition is
one automaton; a clause's score is the sum of the weights on its path. Clauses end at
``.!?;:``, which all but two things forget: what follows a colon is still reported by the
verb before it, and a quotation goes on until its closing mark. A line end closes all; a
line's last mark without a partner quotes nothing. Words that match nothing in the lexicon
can't start a match, so only texts with a lexicon word are run.

Learnt are the insults and the last step. The insult lexicon holds cues, whole words and
word beginnings of 3 to 9 letters (stems), whose document frequency in toxic documents
stands out: weight = log odds less one standard error. A logistic function of a
document's clause scores gives its score; it is fitted on scores under lexicons learnt
from the other half of the rows. Both use at most ``max_rows`` labelled rows, those of the
smallest hashes, whole texts; every document is scored over its whole text.

Defined results: null texts count as empty and get the score of a text without matches.
Labels other than 0 and 1, and labels without a document, are left out; a doc_id with
several labels counts as toxic if one is 1. With fewer than ``LEAST_LABELS`` labelled rows
of either kind the score is the logistic function of the seed lexicon with fixed
coefficients. Repeated rows come
back as often as they came. An empty table gives an empty result. Of documents only
doc_id and text are read, of labels doc_id and toxic; labels, lang, source and doc_id
don't enter a score.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardtrail.llm.common import fold, map_batches

WORDS = re.compile(r"[^\W\d_]+")
#: Words, contractions of not (whole), clause ends and quotation marks.
TOKENS = re.compile(r"[^\W\d_]+(?:(?<=n)['’]t(?![^\W\d_]))?|[.!?;:\"“”„«»]")
CLAUSE_END = frozenset(".!?;:")
QUOTES = frozenset("\"“”„«»")

#: Insults known without labels (fixed values): en, de, fr, es.
SEEDS = ("idiot moron stupid imbecile scum bastard asshole bitch cunt retard loser worthless pathetic disgusting "
         "trottel dummkopf arschloch abschaum hurensohn crétin abruti connard salope ordure pendejo cabrón estúpido basura").split()
SEED_WEIGHT = 2.0
#: Function words of the grammar (fixed values): en, de, fr, es.
CLASSES = {
    "target": "you your you're u he she they them him her du dich dir ihr euch sie er tu te toi vous il elle ils elles tú usted ustedes él ella ellos".split(),
    "negation": "not no never nor cannot neither nicht kein keine nie pas jamais aucun nunca ningún jamás".split(),
    "report": "said says say wrote called calls claimed reported quoted according sagte sagt schrieb nannte laut dit écrit appelé selon dijo dice escribió llamó según".split(),
    "threat": "kill killing hurt hurting destroy destroying punch punching stab stabbing shoot shooting beat beating töten umbringen schlagen tuer frapper détruire matar golpear destruir".split(),
    "done": "killed destroyed punched stabbed shot beaten getötet umgebracht geschlagen tué tués frappé frappés détruit détruits matado golpeado destruido".split(),
    "future": "will shall gonna wirst wird werdet werden seras sera serez seront serás será serán".split(),
}
CONTRACTED = ("'t", "’t")
CLASS_OF = {word: name for name, words in CLASSES.items() for word in words}
MENACES = frozenset(CLASSES["threat"] + CLASSES["done"])
ALPHABET = ("insult", "threat", "done", "future", "target", "negation", "report", "quote", "end", "colon", "other")
ENDS = ("end", "colon")


class Transducer:
    """A deterministic weighted transducer: (state, class) -> (state, factor, added)."""

    def __init__(self, step, start=0):
        self.step, self.start = step, start


def compose(parts: list[Transducer]) -> tuple[dict, tuple]:
    """The reachable product automaton: {(state, class): (state, factor, added)}, start.
    Factors multiply, added weights add and are multiplied by the other parts' factors."""
    start = tuple(p.start for p in parts)
    table, todo = {}, [start]
    while todo:
        state = todo.pop()
        for name in ALPHABET:
            if (state, name) in table:
                continue
            moves = [p.step(s, name) for p, s in zip(parts, state)]
            after = tuple(m[0] for m in moves)
            table[state, name] = (after, float(np.prod([m[1] for m in moves])), sum(m[2] for m in moves))
            todo.append(after)
    return table, start


def _negation(state, name):
    """A negation softens weights of the next three words."""
    if name in ENDS:
        return 0, 1.0, 0.0
    if name == "negation":
        return 3, 1.0, 0.0
    return max(0, state - 1), 0.5 if state else 1.0, 0.0


def _report(state, name):
    """After a verb of saying, over a colon too, and inside quotation marks, weights are
    softened."""
    told, quoted = state
    if name in ENDS:
        return (told if name == "colon" else 0, quoted), 1.0, 0.0
    if name == "report":
        return (1, quoted), 1.0, 0.0
    if name == "quote":
        return (told, 1 - quoted), 1.0, 0.0
    return state, 0.7 if told or quoted else 1.0, 0.0


def _target(state, name):
    """A person named earlier in the clause makes an insult weigh more."""
    if name in ENDS:
        return 0, 1.0, 0.0
    return (1 if name == "target" else state), 1.25 if state and name == "insult" else 1.0, 0.0


def _threat(state, name):
    """THREAT for a threat followed within three words by a target, and for a target
    followed within three words by a future, this within three by what is to be done."""
    aimed, named, foretold = state
    if name in ENDS:
        return (0, 0, 0), 1.0, 0.0
    hit = (name == "target" and aimed) or (name == "done" and foretold)
    after = (3 if name == "threat" else 0 if hit else max(0, aimed - 1),
             3 if name == "target" else max(0, named - 1),
             3 if name == "future" and named else 0 if hit else max(0, foretold - 1))
    return after, 1.0, THREAT if hit else 0.0


THREAT = 1.0
GRAMMAR, START = compose([Transducer(_negation), Transducer(_report, (0, 0)), Transducer(_target), Transducer(_threat, (0, 0, 0))])


def cues(word: str) -> list[str]:
    """The cues of a lower-case word: itself and its beginnings (marked by a star)."""
    return [word, *(word[:k] + "*" for k in range(3, min(len(word), 9) + 1))]


class Lexicon:
    """Insult weights by word, from weights by cue."""

    def __init__(self, weights: dict[str, float]):
        self.weights = {**dict.fromkeys(SEEDS, SEED_WEIGHT), **weights}
        self.heads = {c[:3] for c in self.weights} | {w[:3] for w in MENACES}
        self.known: dict[str, float] = {}

    def weigh(self, words: set[str]) -> None:
        if len(self.known) > 300_000:
            self.known.clear()
        get, heads = self.weights.get, self.heads
        known = self.known
        for word in [w for w in words if w not in known]:
            if word[:3] not in heads:
                known[word] = 0.0
                continue
            best = max(get(c, 0.0) for c in cues(word))
            known[word] = float(best) if best or word not in MENACES else -1.0

    def features(self, text: str) -> tuple[float, float, float]:
        """log of the summed clause scores, the highest one, log of the words; all 0 for a
        text without matches."""
        words = WORDS.findall(text)
        distinct = set(words)
        self.weigh(distinct)
        if not any(map(self.known.__getitem__, distinct)):
            return 0.0, 0.0, 0.0
        total = highest = 0.0
        for score in self.clauses(text):
            total += score
            highest = max(highest, score)
        return float(np.log1p(total)), highest, float(np.log1p(len(words)))

    def clauses(self, text: str):
        """Scores of the clauses that match; clauses of the same matches count once."""
        seen = set()
        for line in text.split("\n"):
            tokens = TOKENS.findall(line)
            lone = max((i for i, t in enumerate(tokens) if t in QUOTES), default=-1) if sum(map(tokens.count, QUOTES)) % 2 else -1
            state, score, matched = START, 0.0, []
            for i, token in enumerate([*tokens, "."]):
                weight = max(0.0, self.known.get(token, 0.0))
                if weight:
                    name = "insult"
                elif token in CLAUSE_END:
                    name = "colon" if token == ":" else "end"
                    if score and (mark := (*matched, score)) not in seen:
                        seen.add(mark)
                        yield score
                    score, matched = 0.0, []
                elif token in QUOTES:
                    name = "other" if i == lone else "quote"
                else:
                    name = "negation" if token[-2:] in CONTRACTED else CLASS_OF.get(token, "other")
                state, factor, added = GRAMMAR[state, name]
                if weight or added:
                    score += factor * (weight + added)
                    matched.append(token)


def _half(doc_id) -> object:
    return F.pmod(F.xxhash64(F.lit(5), doc_id), F.lit(2)).cast("int")


def learn_cues(rows: DataFrame, least: int = 3, floor: float = 1.5) -> list[dict[str, float]]:
    """Cue weights learnt from rows (text, toxic, half): without half 0, without half 1,
    from all. Bounded by the bounded rows."""
    totals = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}

    def run(batches):
        seen: dict[str, list[int]] = {}
        for pdf in batches:
            for text, toxic, half in zip(pdf["text"], pdf["toxic"], pdf["half"]):
                for cue in {c for w in set(WORDS.findall((text or "").lower())) for c in cues(w)}:
                    seen.setdefault(cue, [0, 0, 0, 0])[2 * half + toxic] += 1
        yield pd.DataFrame([(c, *n) for c, n in seen.items()], columns=["cue", "c0", "t0", "c1", "t1"])

    counts = map_batches(rows.select("text", "toxic", "half"), run, "cue string, c0 long, t0 long, c1 long, t1 long")
    counts = counts.groupBy("cue").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1"))).where((F.col("t0") + F.col("t1") >= least) & ((F.col("t0") + F.col("t1")) * 4 > F.col("c0") + F.col("c1")))
    found = counts.toPandas()
    out = []
    for halves in ((1,), (0,), (0, 1)):
        toxic, clean = sum(found[f"t{h}"] for h in halves), sum(found[f"c{h}"] for h in halves)
        all_toxic, all_clean = sum(totals.get((h, 1), 0) for h in halves), sum(totals.get((h, 0), 0) for h in halves)
        weight = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1)) - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        keep = (weight >= floor) & (toxic >= (least if len(halves) > 1 else 2))
        out.append(dict(zip(found["cue"][keep], weight[keep])))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Coefficients (last: intercept) by damped Newton steps on scaled features."""
    middle, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], ridge), 0.0)

    def loss(w):
        t = z @ w
        return np.logaddexp(0, t).sum() - t @ y + 0.5 * penalty @ (w * w)

    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    slopes = w[:-1] / scale
    return np.append(slopes, w[-1] - slopes @ middle)


LEAST_LABELS = 5
#: Coefficients without labels: features, intercept.
UNFITTED = np.array([1.5, 0.5, -0.3, -2.0])


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, max_rows: int = 12_000) -> tuple[dict[str, float], np.ndarray]:
    """(cue weights, coefficients), from labelled rows outside the held fold."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.where(fold("doc_id", folds) != held_fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows rows of two numbers: small enough to broadcast whatever the input
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic", _half("doc_id").alias("half")).cache()
    try:
        kinds = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if min(kinds.get(0, 0), kinds.get(1, 0)) < LEAST_LABELS:
            return {}, UNFITTED
        *crossed, weights = learn_cues(rows)
        lexicons = rows.sparkSession.sparkContext.broadcast(crossed)

        def run(batches):
            readers = [Lexicon(w) for w in lexicons.value]
            for pdf in batches:
                x = [readers[h].features(t.lower()) for t, h in zip(pdf["text"], pdf["half"])]
                out = pd.DataFrame(x, columns=["total", "highest", "words"])
                out["toxic"] = pdf["toxic"].to_numpy()
                yield out

        sample = map_batches(rows, run, "total double, highest double, words double, toxic int").toPandas()
        return weights, fit_logistic(sample[["total", "highest", "words"]].to_numpy(), sample["toxic"].to_numpy(dtype=float))
    finally:
        rows.unpersist()


def _scores(texts, reader: Lexicon, coefficients: np.ndarray) -> np.ndarray:
    x = np.array([reader.features(t.lower()) if t else (0.0, 0.0, 0.0) for t in texts]).reshape(-1, 3)
    return 1 / (1 + np.exp(-np.clip(x @ coefficients[:-1] + coefficients[-1], -30, 30)))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, threshold: float = 0.3, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_fold, max_rows))

    def run(batches):
        weights, coefficients = shared.value
        reader = Lexicon(weights)
        for pdf in batches:
            score = _scores(pdf["text"], reader, coefficients)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": score, "predicted": (score >= threshold).astype(np.int32)})

    rows = docs.select("doc_id", "text", (fold("doc_id", folds) == held_fold).alias("held_out"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 12_000) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows=max_rows))

    def run(batches):
        weights, coefficients = shared.value
        reader = Lexicon(weights)
        for pdf in batches:
            yield pdf[_scores(pdf["text"], reader, coefficients) < threshold]

    return map_batches(docs, run, docs.schema)
