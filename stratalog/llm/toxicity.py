"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns words into classes (insult, threat, target, negation, report,
other) with weights. Four transducers over these classes are composed once into
one table of weighted arcs, which reads a clause word by word:

* negation marks the insults and threats up to three words after it;
* reported speech marks all that follows it in the clause;
* target marks the clause that names a person addressed, before or after;
* the last puts out what insults and threats were found with these marks and
  its weight (a threat needs a target).

A document's evidence is the sum of matched weights for each kind of match.
Which words insult is a fixed list and what the labels teach: words and word
beginnings that occur in toxic texts and hardly in others, chosen so that each
explains toxic texts that those before it do not. The worth of each kind of
match is fitted to the labels too, drawn towards the grammar's own values.
Both come from a bounded sample of about ``sample_per_label`` rows a label.

Defined cases: a null or empty text matches nothing and gets the lowest score;
null labels are not learned from; without labels the fixed lists and weights
stand; repeated rows are scored alike, and exact copies teach once, as toxic if any is;
a null id is passed on; of several labels for one id the smallest counts; other
columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, keep_ids, map_rows, stage
from .learning import bounded_sample, labelled, logistic, sigmoid

# The words that the grammar starts from.
INSULTS = (
    "arschloch cretino clown connard disgusting dumm dummkopf estúpido gilipollas idiot idiota idiote idioten imbécile "
    "imbécil loser moron pathetic salaud scum stupid trash trottel worthless"
).split()
THREATS = "abstechen amenazo beat burn destroy destruir erschießen frapper hurt kill matar murder stab tuer töten verprügeln".split()
TARGETS = "deine dich dir du eres euch ihr te ti toi tu tus tú usted vos votre vous you your yours".split()
NEGATIONS = "aucun isn't jamais kein keine never neither ni nicht nie no nor not nunca pas sans sin without".split()
REPORTS = "called claimed dice dijo dit disait llamó nannte quote quoted said sagte says wrote écrit escribió".split()

KINDS = ("plain", "targeted", "negated", "reported", "threat")
#: The grammar's own worth of a match of each kind, and the intercept.
PRIOR = np.array([3.0, 3.5, 1.0, 1.5, 3.0, -3.0])

_CLAUSE = re.compile(r"[.;!?\n|]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


CLASSES = ("insult", "threat", "target", "negation", "report", "other")


@dataclass(frozen=True)
class Transducer:
    """``arcs[state, symbol]`` gives the next state, the symbol put out and a weight."""

    starts: tuple
    finals: frozenset
    arcs: dict


def transducer(starts: tuple, accepts: Callable, symbols: Iterable, step: Callable) -> Transducer:
    """The table of ``step(state, symbol)`` over all states reached from ``starts``; None is no arc."""
    arcs, left, seen = {}, list(starts), set(starts)
    while left:
        state = left.pop()
        for symbol in symbols:
            arc = step(state, symbol)
            if arc is not None:
                arcs[state, symbol] = arc
                if arc[0] not in seen:
                    seen.add(arc[0])
                    left.append(arc[0])
    return Transducer(starts, frozenset(filter(accepts, seen)), arcs)


def compose(first: Transducer, second: Transducer, symbols: Iterable) -> Transducer:
    """One transducer that does what ``second`` does with what ``first`` puts out; weights multiply."""

    def step(state, symbol):
        one = first.arcs.get((state[0], symbol))
        two = second.arcs.get((state[1], one[1])) if one else None
        return two and ((one[0], two[0]), two[1], one[2] * two[2])

    starts = tuple((p, q) for p in first.starts for q in second.starts)
    return transducer(starts, lambda s: s[0] in first.finals and s[1] in second.finals, symbols, step)


def _negation(left: int, word: str):
    mark = "negated" if left and word in ("insult", "threat") else ""
    return 3 if word == "negation" else max(0, left - 1), (word, mark), 1.0


def _report(on: bool, read: tuple[str, str]):
    word, mark = read
    return on or word == "report", (word, mark or ("reported" if on else "")), 1.0


def _target(guess: str, read: tuple[str, str]):
    # a clause's target may come last: one path awaits it, another dies if it comes
    word = read[0]
    if word != "target":
        return guess, (*read, guess != "none"), 1.0
    return None if guess == "none" else ("seen", (*read, True), 1.0)


def _matches(state: int, read: tuple[str, str, bool]):
    word, mark, targeted = read
    if word == "insult":
        return state, mark or ("targeted" if targeted else "plain"), 1.0
    if word == "threat" and targeted:
        return state, mark or "threat", 1.0
    return state, "", 0.0


def clause_transducer() -> Transducer:
    """Negation, report, target and match transducers composed into one."""
    out = transducer((0,), lambda s: True, CLASSES, _negation)
    for starts, accepts, step in (
        ((False,), lambda s: True, _report),
        (("none", "awaited"), lambda s: s != "awaited", _target),
        ((0,), lambda s: True, _matches),
    ):
        read = {put for _, put, _ in out.arcs.values()}
        out = compose(out, transducer(starts, accepts, read, step), CLASSES)
    return out


CLAUSE_TRANSDUCER = clause_transducer()


class Grammar:
    """The lexicon, by whole words and by beginnings of words, and the composed transducer."""

    def __init__(self, words: dict[str, float], heads: dict[str, float]):
        self.words, self.heads = words, heads
        self.lengths = sorted({len(h) for h in heads})
        self.classes = (
            {w: "threat" for w in THREATS} | {w: "target" for w in TARGETS} | {w: "negation" for w in NEGATIONS} | {w: "report" for w in REPORTS}
        )
        self._finder = None

    def weight(self, word: str) -> float:
        got = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) >= n:
                got = max(got, self.heads.get(word[:n], 0.0))
        return got

    def finder(self):
        """An automaton of all insults and threats, made once in each worker."""
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for w in {*self.words, *self.heads, *THREATS}:
                self._finder.add_word(w, len(w))
            self._finder.make_automaton()
        return self._finder

    def __getstate__(self):
        return self.__dict__ | {"_finder": None}

    def evidence(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Summed weights by kind, and the spans of the matched clauses."""
        out, spans = np.zeros(len(KINDS)), []
        if not text:
            return out, spans
        low = text.lower()
        lo, done = 0, -1
        for end, n in self.finder().iter(low):
            begin = end - n + 1
            if begin < done or (begin and low[begin - 1].isalpha()):
                continue
            for mark in _CLAUSE.finditer(low, max(0, done), begin):  # from where the clause before ended
                lo = mark.end()
            after = _CLAUSE.search(low, end)
            done = after.start() if after else len(low)
            found = self.clause(low[lo:done])
            if found:
                spans.append((lo, done))
                for kind, weight in found:
                    out[KINDS.index(kind)] += weight
        return out, spans

    def clause(self, clause: str) -> list[tuple[str, float]]:
        words = _WORD.findall(clause)
        weights = [self.weight(w) for w in words]
        classes = ["insult" if v else self.classes.get(w, "other") for w, v in zip(words, weights)]
        return run_clause(CLAUSE_TRANSDUCER, classes, weights)


def run_clause(machine: Transducer, classes: list[str], weights: list[float]) -> list[tuple[str, float]]:
    """The matches on the one path that accepts the whole clause, each with its word's weight times the arc's."""
    for state in machine.starts:
        found = []
        for name, weight in zip(classes, weights):
            arc = machine.arcs.get((state, name))
            if arc is None:
                break
            state, kind, worth = arc
            if kind:
                found.append((kind, worth * (weight or 1.0)))
        else:
            if state in machine.finals:
                return found
    return []


def terms(text: str) -> list[str]:
    """Words of a text, and their beginnings of 4 to 6 letters with a star."""
    words = set(_WORD.findall(text.lower()))
    return list(words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n})


def learn_lexicon(sample: DataFrame, support: int = 4, fresh: int = 2, ratio: float = 12.0, clean_share: float = 0.002) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings from ``sample(doc_id, text, y)``.

    Candidates occur in ``support`` toxic texts or more and ``ratio`` times as
    often in toxic texts as in others. They are taken while one explains
    ``fresh`` toxic texts that none before it does.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for doc_id, text, y in zip(part["doc_id"].tolist(), part["text"].tolist(), part["y"].tolist()):
                yield pd.DataFrame({"doc_id": [doc_id], "y": [y], "terms": [terms(text or "")]})

    rows = stage(sample.mapInPandas(cut, "doc_id long, y double, terms array<string>"), "terms")
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = totals.get(1.0, 0), totals.get(0.0, 0)
    if not toxic or not clean:
        return {}, {}
    counted = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    share = ((F.col("t") + 0.5) / toxic) / ((F.col("n") - F.col("t") + 0.5) / clean)
    good = counted.where((F.col("t") >= support) & (share >= ratio) & (F.col("n") - F.col("t") <= 2 + clean_share * clean))
    good = stage(good.select("term", "t", (F.col("n") - F.col("t")).alias("c")), "lexicon")
    held = (
        rows.where("y = 1")
        .select("doc_id", F.explode("terms").alias("term"))
        .join(good, "term")
        .groupBy("term")
        .agg(F.collect_set("doc_id").alias("docs"), F.first("c").alias("c"))
        .collect()
    )  # at most the toxic rows of the bounded sample for each term
    left = {r["term"]: set(r["docs"]) for r in held}
    spoil = {r["term"]: r["c"] for r in held}
    support_of = {k: len(v) for k, v in left.items()}
    words: dict[str, float] = {}
    heads: dict[str, float] = {}
    while left:
        worth = lambda k: (len(left[k]) - 2 * spoil[k], -spoil[k], not k.endswith("*"), len(k), k)
        best = max(left, key=worth)
        gone = left[best]
        if len(gone) < fresh or worth(best)[0] <= 0:
            break
        gain = np.log((support_of[best] + 0.5) / toxic) - np.log((spoil[best] + 0.5) / clean)
        (heads if best.endswith("*") else words)[best.rstrip("*")] = float(np.clip(gain / 4, 0.25, 2.0))
        gone = set(gone)
        left = {k: v - gone for k, v in left.items()}
        left = {k: v for k, v in left.items() if len(v) >= fresh}
    return words, heads


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train_fold: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_per_label: int = 3000,
) -> DataFrame:
    """``doc_id, score, predicted, n_clauses`` for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labelled(labels.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), labels, id_col, label_col, train_fold)
    chosen = stage(bounded_sample(known, "doc_id", "y", sample_per_label), "chosen")
    rows = keep_ids(slim, chosen.select("doc_id"), "doc_id").join(F.broadcast(chosen), "doc_id")  # bounded by the sample
    sample = stage(rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")), "sample")
    words, heads = learn_lexicon(sample)
    grammar = Grammar({w: 1.0 for w in INSULTS} | words, heads)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"y": part["y"], "e": [grammar.evidence(t)[0] for t in part["text"].tolist()]})

    got = sample.mapInPandas(weigh, "y double, e array<double>").collect()  # one short row for each row of the sample
    fitted = PRIOR
    if got and len({r["y"] for r in got}) == 2:
        x = np.log1p(np.array([r["e"] for r in got]))
        fitted = logistic(x, np.array([r["y"] for r in got]), PRIOR, 0.5)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            both = [grammar.evidence(t) for t in part["text"].tolist()]
            if both:
                score = sigmoid(np.log1p(np.array([e for e, _ in both])) @ fitted[:-1] + fitted[-1])
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"],
                        "score": score,
                        "predicted": (score >= 0.5).astype("int32"),
                        "n_clauses": np.array([len(s) for _, s in both], dtype="int32"),
                    }
                )

    return map_rows(slim, predict, "doc_id long, score double, predicted int, n_clauses int")
