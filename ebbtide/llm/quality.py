"""Learned decision lists over text statistics (operator 4).

Sequential covering: rules that reject are grown on two thirds of labelled rows and pruned
on the rest, one after the other, each a conjunction of thresholds on shares of a text.
What no rule rejects is kept. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import query, stored, table, with_column

WINDOW = 5
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED = 20
#: Labelled rows the rules are learned from at most, chosen by a hash of the id.
LABELLED = 50_000
#: A rule must be right for this share of the rows it covers, and cover this many rejects.
PRECISION = 0.95
LEAST_COVER = 4
#: Conditions a rule has at most, rules a list has at most, thresholds tried per share.
CONDITIONS, RULES, THRESHOLDS = 3, 20, 200

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct", "n_same", "n_top"]
# The shares that rules may use, over the counts; a zero divisor counts as one.
SHARES = {
    "symbols_per_word": ("n_symbols", "n_words"), "dup_lines_per_line": ("n_dup_lines", "n_lines"), "repeats_per_word": ("n_repeat_words", "n_words"),
    "upper_per_letter": ("n_upper", "n_letters"), "digits_per_char": ("n_digits", "word_chars"), "marks_per_word": ("n_marks", "n_words"),
    "distinct_per_word": ("n_distinct", "n_words"), "same_as_before_per_word": ("n_same", "n_words"), "top_word_per_word": ("n_top", "n_words"),
    "chars_per_word": ("word_chars", "n_words"), "letters_per_char": ("n_letters", "word_chars"),
}

_ASCII_SPACES = " \t\n\x0b\x0c\r"
_UPPER = re.compile(r"[A-Z]+")
# Runs of letters that may be capitals; those of most scripts are none, so each letter is asked.
_MAYBE_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]+")


def _capitals(text: str) -> int:
    """Letters that are capitals in their script; scripts without case have none."""
    if text.isascii():
        return sum(map(len, _UPPER.findall(text)))
    return sum(sum(map(str.isupper, run)) for run in _MAYBE_UPPER.findall(text))


def statistics(text: str | None) -> list[int]:
    """The counts of one text; a null text has none."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _ASCII_SPACES))
    lines = [x for x in text.split("\n") if x.strip(_ASCII_SPACES)]
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1)) if n else []
    repeated = 0
    if n >= WINDOW:
        joined = b" ".join(words)
        starts = [0, *(e + 1 for e in ends)]
        windows = [joined[a:b] for a, b in zip(starts, ends[WINDOW - 1 :])]
        found = Counter(windows)
        if len(found) < len(windows):
            # Words up to `covered` belong to a repeated window that began before.
            covered = 0
            for i, w in enumerate(windows):
                if found[w] > 1:
                    repeated += i + WINDOW - max(covered, i)
                    covered = i + WINDOW
    of = Counter(words)
    letters = sum(map(len, _LETTERS.findall(text)))
    upper = _capitals(text)
    digits = sum(map(len, _DIGITS.findall(text)))
    return [
        n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, letters, digits,
        chars - letters - digits, len(of), sum(map(bytes.__eq__, words, words[1:])), max(of.values(), default=0),
    ]


def _counted(texts: pa.Array) -> pa.Array:
    rows = np.array([statistics(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], COUNTS)


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct of counts of every whole text, under ``name``."""
    return with_column(docs, text_col, name, f"struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>", _counted, keep)


def base_failed(stats: str = "stats") -> Column:
    """Too few words, or too many in windows that repeat."""
    return F.expr(f"{stats}.n_words < {LEAST_WORDS} or 100 * {stats}.n_repeat_words > {MOST_REPEATED} * {stats}.n_words")


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(share, at_least, threshold)`` that rejects."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(values.values()))), bool)
        for share, above, at in self.conditions:
            hit &= values[share] >= at if above else values[share] < at
        return hit

    def sql(self, stats: str = "stats") -> str:
        def one(share: str, above: bool, at: float) -> str:
            a, b = SHARES[share]
            return f"{stats}.{a} / greatest({stats}.{b}, 1) {'>=' if above else '<'} {at!r}D"

        return " AND ".join(one(*c) for c in self.conditions)


def _grown(values: dict[str, np.ndarray], bad: np.ndarray) -> list[tuple[str, bool, float]]:
    """Add the condition that gains most information until no good row is covered."""
    conditions: list[tuple[str, bool, float]] = []
    hit = np.ones(len(bad), bool)
    while len(conditions) < CONDITIONS and (~bad[hit]).any():
        p0, n0 = bad[hit].sum(), (~bad[hit]).sum()
        best = (1e-9, None)
        for share, column in values.items():
            order = np.argsort(column[hit], kind="stable")
            value, sign = column[hit][order], bad[hit][order]
            edges = np.flatnonzero(value[1:] > value[:-1]) + 1
            if not len(edges):
                continue
            if len(edges) > THRESHOLDS:
                edges = edges[np.linspace(0, len(edges) - 1, THRESHOLDS).astype(int)]
            below_bad, below = np.concatenate([[0], np.cumsum(sign)])[edges], edges
            for above, p, n in ((False, below_bad, below - below_bad), (True, p0 - below_bad, n0 - (below - below_bad))):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (share, above, float((value[edges[k] - 1] + value[edges[k]]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        hit &= Rule((best[1],)).covers(values)
    return conditions


def learn(values: dict[str, np.ndarray], bad: np.ndarray, prunes: np.ndarray) -> list[Rule]:
    """The ordered rules for rows of shares; ``prunes`` marks the rows that prune."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < RULES:
        grow, prune = left & ~prunes, left & prunes
        if bad[grow].sum() < LEAST_COVER:
            break
        conditions = _grown({k: v[grow] for k, v in values.items()}, bad[grow])
        best: tuple[float, Rule] | None = None
        for k in range(1, len(conditions) + 1):
            rule = Rule(tuple(conditions[:k]))
            hit = rule.covers(values) & prune
            p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
            worth = (p - n) / (p + n + 1)
            if best is None or worth > best[0]:
                best = (worth, rule)
        if best is None:
            break
        hit = best[1].covers(values) & left
        if bad[hit].sum() < LEAST_COVER or bad[hit].mean() < PRECISION:
            break
        rules.append(best[1])
        left &= ~hit
    return rules


def learned_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = LABELLED) -> list[Rule]:
    """Learn rules from the rows of ``stats`` (id and struct ``stats``) that have a label.

    Label 0 is to be rejected, any other kept; rows without label teach nothing. At most
    ``most`` rows reach the driver, those with the smallest hash of their id; it is the only
    sample here. Without rejects, or without labels, there are no rules.
    """
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where("id is not null and label is not null").dropDuplicates(["id"])
    rows = (
        stats.select(F.col(f"`{id_col}`").alias("id"), "stats").join(named, "id").where(~base_failed())
        .select("id", "label", *[F.expr(f"stats.{a} / greatest(stats.{b}, 1)").alias(s) for s, (a, b) in SHARES.items()])
        .orderBy(F.xxhash64("id"), "id", *SHARES).limit(most).toArrow()
    )
    if not rows.num_rows:
        return []
    values = {s: rows.column(s).to_numpy() for s in SHARES}
    return learn(values, rows.column("label").to_numpy() == 0, np.arange(rows.num_rows) % 3 == 2)


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """True for kept rows: the base checks, then the rules in order, else kept."""
    out = F.when(base_failed(stats), False)
    for rule in rules:
        out = out.when(F.expr(rule.sql(stats)), False)
    return out.otherwise(True)


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base checks and the learned rules keep, all columns as they are.

    A null or empty text has no words and goes. Null and repeated ids are judged like any
    other row. Without labels the base checks alone decide.
    """
    clash = {"stats": "stats__own"} if "stats" in docs.columns else {}
    marked = stored(with_statistics(docs.withColumnsRenamed(clash), text_col), "judged")
    rules = learned_rules(marked, labels, id_col)
    return marked.where(verdict(rules)).drop("stats").withColumnsRenamed({v: k for k, v in clash.items()})


@query("op4_quality_rules")
def op4_quality_rules(spark, folder):
    """The counts of every document, the base checks and the verdict of the learned list."""
    stats = stored(with_statistics(table(spark, folder, "documents"), keep=["doc_id"]), "statistics")
    rules = learned_rules(stats, table(spark, folder, "labels"))
    return stats.select("doc_id", *[f"stats.{c}" for c in COUNTS[:5]], base_failed().alias("base_failed"), verdict(rules).alias("kept"))
