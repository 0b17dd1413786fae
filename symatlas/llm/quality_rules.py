"""Quality rules as weak supervision (operator 2).

Every rule votes good, bad or abstains; expectation-maximisation over the counts of vote patterns
estimates how often each rule votes what on good and on bad documents; the posterior probability of
being good replaces all-must-pass filtering. Only the table of distinct vote patterns (at most
3 ** len(RULES) rows, whatever the corpus) reaches the driver.

Defined results: a null or empty text has no words, all counts 0, and fails the base test; repeated
rows are judged one by one and alike; an empty table gives an empty result; columns other than
doc_id and text are ignored by score(), and all are returned unchanged by keep().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ROUNDS = 50
THRESHOLD = 0.5

#: Frequent function words of the languages of the corpus.
STOP_WORDS = frozenset(
    """a an and are as at be by for from have he in is it not of on or that the this to was were which with
    aber als auch auf aus bei das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu
    au avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une
    al como con de del el en es esta la las lo los más no para por que se su un una y""".split()
)
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))

#: (rule, feature, bad from, good up to): votes bad above the first bound, good up to the second, else
#: abstains. A rule with bounds the other way round votes bad below the first and good from the second.
RULES = (
    ("symbols", "symbols_per_word", 0.10, 0.02),
    ("upper_case", "upper_share", 0.40, 0.15),
    ("exclaimed", "exclaimed_share", 0.20, 0.05),
    ("repeated_lines", "dup_line_share", 0.30, 0.02),
    ("repeated_words", "repeat_share", 0.35, 0.15),
    ("function_words", "stop_share", 0.04, 0.10),
    ("long_words", "mean_word", 12.0, 9.0),
    ("table_cells", "lone_symbol_share", 0.15, 0.02),
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids, size = common.word_ids(words)
    pair = ids[:-1] * size + ids[1:]
    if size >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * size + ids[2:]
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def measures(text: bytes) -> tuple[tuple[int, int, int, int, int], dict[str, float]]:
    """The base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the rules' features."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, sum(text.count(c) for c in _SYMBOLS), 0, 0), dict.fromkeys((r[1] for r in RULES), 0.0)
    raw = np.frombuffer(text, np.uint8)
    chars = sum(map(len, words)) - int(np.count_nonzero((raw & 0xC0) == 0x80))
    symbols = sum(text.count(c) for c in _SYMBOLS)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeated_words(words)
    upper = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    lower = int(np.count_nonzero((raw >= 97) & (raw <= 122)))
    features = {
        "symbols_per_word": symbols / n,
        "upper_share": upper / max(1, upper + lower),
        "exclaimed_share": (text.count(b"! ") + text.count(b"!\n") + text.endswith(b"!")) / n,
        "dup_line_share": dup / max(1, lines),
        "repeat_share": repeat / n,
        "stop_share": sum(map(_STOP.__contains__, text.lower().split())) / n,
        "mean_word": chars / n,
        "lone_symbol_share": sum(words.count(w) for w in (b"|", b"*", b"-", b"#")) / n,
    }
    return (n, chars, symbols, dup, repeat), features


def vote_code(features: dict[str, float]) -> int:
    """The rules' votes as digits to the base 3: 0 bad, 1 abstain, 2 good."""
    code = 0
    for _, feature, bad, good in RULES:
        x = features[feature]
        if bad > good:
            vote = 0 if x > bad else 2 if x <= good else 1
        else:
            vote = 0 if x < bad else 2 if x >= good else 1
        code = code * 3 + vote
    return code


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def votes(code: int) -> list[int]:
    digits = []
    for _ in RULES:
        digits.append(code % 3)
        code //= 3
    return digits[::-1]


def fit(counts: dict[int, int]) -> dict[int, float]:
    """Posterior probability of "good" for each vote pattern, by expectation-maximisation.

    The rules are taken as independent given the class. It starts from the numbers of bad votes, as a
    rule speaks up against few documents and a good vote is the common case; pseudo-counts keep a rule that always abstains or always agrees from taking probability 0 or 1;
    the class whose documents got more good votes is "good".
    """
    if not counts:
        return {}
    codes = sorted(counts)
    digits = np.array([votes(c) for c in codes])
    weight = np.array([counts[c] for c in codes], float)
    score = (digits - 1).sum(1)
    good = 1 / (1 + np.exp(1.5 * (digits == 0).sum(1) - 2.0))
    hot = np.eye(3)[digits]
    for _ in range(ROUNDS):
        mass = np.array([(weight * (1 - good)).sum(), (weight * good).sum()]) + 1.0
        prior = np.log(mass / mass.sum())
        each = np.stack([np.einsum("p,prv->rv", weight * (1 - good), hot), np.einsum("p,prv->rv", weight * good, hot)])
        # a rule is taken to be better than chance: its pseudo-counts lean to the right side
        each += np.array([[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]])[:, None, :]
        chance = np.log(each / each.sum(2, keepdims=True))
        joint = prior[:, None] + np.einsum("crv,prv->cp", chance, hot)
        nxt = 1 / (1 + np.exp(np.clip(joint[0] - joint[1], -700, 700)))
        done = np.abs(nxt - good).max() < 1e-9
        good = nxt
        if done:
            break
    if (good * weight * score).sum() / max(1e-9, (good * weight).sum()) < ((1 - good) * weight * score).sum() / max(1e-9, ((1 - good) * weight).sum()):
        good = 1 - good
    return {c: float(g) for c, g in zip(codes, good)}


_FIELDS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("votes", pa.int32()),
]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and the vote pattern of every document."""

    def make():
        def step(batch):
            rows = []
            for text in common.texts(batch):
                base, more = measures(text)
                rows.append((*base, base_failed(base[0], base[4]), vote_code(more)))
            return {"doc_id": batch.column("doc_id"), **dict(zip((f[0] for f in _FIELDS), zip(*rows)))}

        return step

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes int"
    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, schema, [("doc_id", pa.int64()), *_FIELDS])


def pattern_counts(found: DataFrame) -> dict[int, int]:
    """Documents for each vote pattern, of those that pass the base test; at most 3 ** len(RULES) rows."""
    return {r["votes"]: r["count"] for r in found.filter(~F.col("base_failed")).groupBy("votes").count().collect()}


def posterior(model: dict[int, float]) -> Column:
    pairs = [F.lit(x) for c, p in sorted(model.items()) for x in (c, p)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("votes")), F.lit(0.0)) if pairs else F.lit(0.0)


def score(docs: DataFrame) -> DataFrame:
    """The base counts, base_failed, kept and posterior of every document."""
    found = common.written(features(docs), "rules")
    return (
        found.withColumn("posterior", F.when(F.col("base_failed"), F.lit(0.0)).otherwise(posterior(fit(pattern_counts(found)))))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= THRESHOLD))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    )


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns: two passes over the texts and no join."""
    model = fit(pattern_counts(features(docs)))
    passed = frozenset(c for c, p in model.items() if p >= THRESHOLD)

    def run(batches):
        for batch in batches:
            mask = []
            for text in common.texts(batch):
                base, more = measures(text)
                mask.append(not base_failed(base[0], base[4]) and vote_code(more) in passed)
            yield batch.filter(pa.array(mask, pa.bool_()))

    common.tuned(docs.sparkSession)
    docs, named = common.numbered(docs, "text")
    return named(docs.mapInArrow(run, docs.schema))


def op2(spark, sf_dir):
    return score(common.table(spark, sf_dir, "documents", "doc_id", "text"))
