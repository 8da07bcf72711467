"""Personal data by weak supervision (operator 4).

*Base* spans follow fixed patterns and are always kept. *Candidate* spans are looser forms
of the same four kinds (spelled-out addresses, national phone numbers, other separators).
Labelers of three sorts vote on every span, for, against or not at all: patterns (checksums
and lengths), gazetteers (domains, issuers, area codes) and context words near by. Over all
spans of the corpus, expectation-maximisation estimates how reliable each labeler is, from
the counts of the vote patterns alone, which are bounded in number; a logistic span
classifier trained on the estimated labels then decides which candidates become spans.

Base matches are leftmost and non-overlapping per kind, found in linear time: an address
from its ``@``, numbers from the start of a run of digits. Defined results: a null text is
empty; ``n_*`` count base spans; a candidate that overlaps a base span, or a candidate
before it, is none. Offsets are code points, ends exclusive. Repeated rows, null ids and
clashing extra columns need no special case; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.resident import release
from tessella.runtime import materialize

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, kind

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]").search


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, by start and then kind."""
    out: list[Span] = []
    if not _ANY(text):
        return out
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


#: Looser forms, each with its kind. Quantifiers are bounded, so each is linear in the text.
_LOOSE = (
    (0, re.compile(r"(?<![\w.@])[A-Za-z0-9][A-Za-z0-9._+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}| AT ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| DOT ) ?[A-Za-z]{2,24}){1,4}(?![\w@])")),
    (1, re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:.])|(?<![0-9.\[])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9\[])")),
    (2, re.compile(r"(?<![\w.+-])[0-9]{4}(?:[./_][0-9]{4}){3}(?![\w])|(?<![\w.+-])[0-9]{13}(?![\w.-])")),
    (3, re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])|(?<![\w+.-])00[1-9][0-9 ()-]{8,18}[0-9](?![\w-])")),
)
_TLDS = frozenset("com org net edu gov io info biz co de fr es uk eu us ch at nl it pl".split())
_NEAR = (
    frozenset("email e-mail mail mailto contact write courriel correo adresse".split()),
    frozenset("ip host server address addr gateway dns ping node client".split()),
    frozenset("card credit visa mastercard amex debit payment karte carte tarjeta".split()),
    frozenset("phone tel telephone call fax mobile cell telefon téléphone teléfono".split()),
)
_AGAINST = frozenset("version v isbn order invoice serial ref id no release build license token password sku".split())
_WORDS = re.compile(r"[^\W\d_](?:[\w-]{0,30}\w)?")
LABELERS = ("shape", "length", "gazetteer", "context", "other_context", "boundary")


def votes(text: str, span: Span) -> tuple[int, ...]:
    """What each of ``LABELERS`` says of a span: 1 for, -1 against, 0 nothing."""
    start, end, kind = span
    body = text[start:end]
    digits = _digits(body)
    before, after = text[max(0, start - 32) : start], text[end : end + 16]
    near = {w.lower() for w in _WORDS.findall(before)} | {w.lower() for w in _WORDS.findall(after)}
    if kind == 0:
        shape = 1 if "@" in body else 0
        length = 1 if 6 <= len(body) <= 80 else -1
        gazetteer = 1 if re.split(r"[^A-Za-z0-9]+", body.lower())[-1] in _TLDS else -1
    elif kind == 1:
        parts = re.split(r"[^0-9A-Fa-f]+", body)
        shape = 1 if len(parts) in (4, 8) else -1
        length = -1 if len(parts) == 4 and any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        gazetteer = -1 if parts[0] in ("0", "00") else 1 if len(parts) == 8 or all(p.isdigit() and int(p[-4:]) <= 255 for p in parts) else -1
    elif kind == 2:
        shape = 1 if luhn(digits) else -1
        length = 1 if 13 <= len(digits) <= 19 else -1
        gazetteer = 1 if digits[:1] in ("3", "4", "5", "6") else -1
    else:
        shape = 1 if re.search(r"[\x20().-]", body) or body[0] == "+" else -1
        length = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = 1 if body[0] == "+" or "555" in digits or digits[:2] == "00" else -1 if digits[0] in "01" else 0
    context = 1 if near & _NEAR[kind] else 0
    other = -1 if near & _AGAINST else 0
    boundary = -1 if (before[-1:].isalnum() or after[:1].isalnum()) else 1
    return shape, length, gazetteer, context, other, boundary


def pattern(kind: int, vote: tuple[int, ...]) -> int:
    """One integer for a kind and its votes."""
    code = kind
    for v in vote:
        code = code * 3 + v + 1
    return code


N_PATTERNS = len(KINDS) * 3 ** len(LABELERS)


def unpattern(code: int) -> tuple[int, tuple[int, ...]]:
    vote = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        vote.append(v - 1)
    return code, tuple(reversed(vote))


def candidates(text: str, base: list[Span]) -> list[tuple[Span, int]]:
    """Looser spans that overlap no base span, with their vote patterns."""
    out: list[tuple[Span, int]] = []
    if not re.search(r"[0-9]|\bAT\b|[(\[{]at[)\]}]", text):
        return out
    taken = [(a, b) for a, b, _ in base]
    for kind, loose in _LOOSE:
        taken.sort()
        starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for m in loose.finditer(text):  # matches of one form do not overlap each other
            a, b = m.span()
            before = bisect_left(starts, b)  # spans that start before this one ends
            if not before or ends[before - 1] <= a:
                out.append(((a, b, kind), pattern(kind, votes(text, (a, b, kind)))))
                taken.append((a, b))
    return sorted(out)


def dawid_skene(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """The probability that a span of each vote pattern is personal data.

    Labelers vote independently given the truth, each with its own rates of the three
    votes; a symmetric prior keeps rates away from 0 and 1. The first guess is the mean vote.
    """
    codes = sorted(counts)
    if not codes:
        return {}
    kinds = np.array([unpattern(c)[0] for c in codes])
    vote = np.array([unpattern(c)[1] for c in codes])
    weight = np.array([counts[c] for c in codes], dtype=float)
    truth = 1 / (1 + np.exp(-1.5 * vote.sum(axis=1)))
    onehot = np.stack([vote == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        odds = np.zeros(len(codes))
        for kind in range(len(KINDS)):
            pick = kinds == kind
            share = (np.sum(weight[pick] * truth[pick]) + 2) / (weight[pick].sum() + 3)
            odds[pick] += np.log(share) - np.log(1 - share)
        for y, sign in ((truth, 1), (1 - truth, -1)):
            rate = np.einsum("n,nlv->lv", weight * y, onehot) + 1
            rate /= rate.sum(axis=1, keepdims=True)
            odds += sign * np.einsum("nlv,lv->n", onehot, np.log(rate))
        truth = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(codes, truth.tolist()))


@dataclass
class SpanClassifier:
    """Logistic regression on kinds and votes."""

    weights: np.ndarray

    @staticmethod
    def features(code: int) -> np.ndarray:
        kind, vote = unpattern(code)
        out = np.zeros(len(KINDS) + 2 * len(LABELERS))
        out[kind] = 1
        for k, v in enumerate(vote):
            out[len(KINDS) + 2 * k + (v > 0)] = abs(v)
        return out

    @classmethod
    def train(cls, labels: dict[int, float], counts: dict[int, int], rounds: int = 50) -> SpanClassifier:
        if not counts:
            return cls(np.zeros(len(KINDS) + 2 * len(LABELERS)))
        x = np.stack([cls.features(c) for c in counts])
        y = np.array([labels[c] for c in counts])
        n = np.sqrt(np.array(list(counts.values()), dtype=float))  # tempers the common patterns
        w = np.zeros(x.shape[1])
        for _ in range(rounds):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (p - y)) + 0.1 * w
            hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step / max(1.0, np.abs(step).max())
        return cls(w)

    def accepted(self) -> frozenset[int]:
        """All vote patterns whose spans count as personal data."""
        return frozenset(c for c in range(N_PATTERNS) if self.features(c) @ self.weights >= 0)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base array<int>, patterns array<int>, loose array<int>, loose_patterns array<int>"


def find_all(docs: DataFrame, *keep: str) -> DataFrame:
    """Base and candidate spans, three integers each, of every text, with vote patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ints = pa.list_(pa.int32())
        for batch in batches:
            rows = []
            for text in batch.column("text_").to_pylist():
                text = text or ""
                base = base_spans(text)
                loose = candidates(text, base)
                n = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
                rows.append((*n, [x for s in base for x in s], [pattern(s[2], votes(text, s)) for s in base], [x for s, _ in loose for x in s], [p for _, p in loose]))
            columns = list(zip(*rows)) or [[]] * 8
            arrays = [pa.array(c, pa.int64() if k < 4 else ints) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *arrays], [*keep, "n_email", "n_ip", "n_card", "n_phone", "base", "patterns", "loose", "loose_patterns"])

    rows = docs.select(*keep, F.col("text").alias("text_"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), FOUND]))


def learn(found: DataFrame) -> frozenset[int]:
    """The accepted vote patterns, from the counts of all patterns of ``found``."""
    seen = found.select(F.explode(F.concat("patterns", "loose_patterns")).alias("p")).groupBy("p").count()
    counts = {r.p: r["count"] for r in seen.collect()}  # at most N_PATTERNS rows
    return SpanClassifier.train(dawid_skene(counts), counts).accepted()


def accepted_spans(base: list[int], loose: list[int], loose_patterns: list[int], accepted: frozenset[int]) -> list[Span]:
    """Base spans and accepted candidates, by start and kind."""
    spans = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
    spans += [tuple(loose[3 * i : 3 * i + 3]) for i, p in enumerate(loose_patterns) if p in accepted]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts and digest, and all spans of every row of ``docs``."""
    found = materialize(find_all(docs, "doc_id"), "pii")
    accepted = learn(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, texts = [], []
            for base, loose, codes in zip(*(batch.column(c).to_pylist() for c in ("base", "loose", "loose_patterns"))):
                shas.append(hashlib.sha256(render([tuple(base[i : i + 3]) for i in range(0, len(base), 3)]).encode()).hexdigest())
                texts.append(render(accepted_spans(base, loose, codes, accepted)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets."""
    from pyspark.sql.functions import pandas_udf

    accepted = learn(find_all(docs))

    @pandas_udf("string")
    def masked(texts):
        def one(text):
            if text is None or not re.search(r"[0-9@]|at|AT", text):
                return text
            base = base_spans(text)
            spans = base + [s for s, p in candidates(text, base) if p in accepted]
            out, at = [], 0
            for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
                if b <= at:
                    continue
                if a >= at:
                    out += [text[at:a], f"[{KINDS[k].upper()}]"]
                at = b
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", masked("text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
