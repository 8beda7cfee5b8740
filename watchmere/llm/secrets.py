"""Secret scan: rules, and a linear-chain conditional random field that tags tokens as begin, inside or outside.

Tokens are runs of letters and digits, and single other characters. The field looks at each token's shape, at the words
before and after it and at features of the whole file, and is decoded by Viterbi. It is fitted here, on windows around
unusual tokens of at most TRAIN_DOCUMENTS documents, labelled by the rules. Everything is then scanned: a token that is
a plain word far from digits and key words cannot begin a secret, so chains are decoded where unusual tokens stand,
with CONTEXT characters on either side.

A null text is empty and has no spans. Texts are read whole, one at a time. Repeated rows each get their own row. With
no text to learn from, weights are zero and only the rules find anything. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.llm.common import scan_rows, table

TRAIN_DOCUMENTS = 300
TRAIN_WINDOWS = 500
EPOCHS = 6
CONTEXT = 80
LEAST_SECRET = 8
# The rules. Letters of the key words count in either case.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
HINT = r"(?i:passw|secret|token|api|auth|bearer|credential|private|key)"
UNUSUAL = re.compile(rf"(?<![A-Za-z0-9])(?:(?=[A-Za-z]*[0-9])[A-Za-z0-9]{{6,}}|[A-Za-z0-9]{{20,}}|{HINT}[a-z]{{0,8}}(?=[\x20\"']*[:=]))")
HINTED = re.compile(HINT)
BEGIN, INSIDE, OUTSIDE = range(3)
FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:int,end:int>>"


def rule_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the secret itself) of what the rules find, leftmost and without overlap by kind."""
    found = [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


@dataclass
class Window:
    tokens: list[tuple[str, int, int]]
    features: list[list[str]]


def shape_of(token: str) -> list[str]:
    if not token[0].isalnum():
        return ["mark=" + token]
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    kind = "digits" if digits == n else "letters" if not digits else "hex" if re.fullmatch("[0-9a-f]+", token) else "mixed"
    case = "upper" if token.isupper() else "lower" if token.islower() else "title" if token.istitle() else "both"
    counts = np.unique(list(token), return_counts=True)[1] / n
    bits = float(-(counts * np.log2(counts)).sum())
    size = next(name for limit, name in ((4, "1-3"), (8, "4-7"), (16, "8-15"), (24, "16-23"), (40, "24-39"), (1 << 62, "40-")) if n < limit)
    return [f"kind={kind}", f"size={size}", f"{kind}/{size}", f"case={case}", f"bits={min(5, int(bits))}", f"{kind}/turns={min(4, turns(token))}"]


def turns(token: str) -> int:
    """How often letters and digits take turns."""
    return len(re.findall(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]", token))


def file_features(text: str) -> list[str]:
    per_thousand = 1000 * (text.count("=") + text.count("{") + text.count(";")) / max(1, len(text))
    return [f"code={min(3, int(math.log2(1 + per_thousand)))}"]


def windows_of(text: str) -> list[Window]:
    """Stretches around unusual tokens; those that touch are one."""
    stretches: list[list[int]] = []
    for m in UNUSUAL.finditer(text):
        start, end = max(0, m.start() - CONTEXT), m.end() + CONTEXT
        if stretches and start <= stretches[-1][1]:
            stretches[-1][1] = end
        else:
            stretches.append([start, end])
    whole = file_features(text) if stretches else []
    out = []
    for start, end in stretches:
        while start > 0 and text[start - 1].isalnum() and text[start].isalnum():
            start -= 1
        tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text, start, min(end, len(text)))]
        shapes = [shape_of(t[0]) for t in tokens]
        features = []
        for i, shape in enumerate(shapes):
            row = ["bias", *shape, *whole]
            for back in (1, 2, 3, 4):
                if i >= back:
                    near = tokens[i - back][0]
                    if HINTED.match(near):
                        row.append(f"hint-{back}")
                    if back <= 2:
                        row.append(f"before{back}={near if not near[0].isalnum() else 'word'}")
            if i + 1 < len(tokens):
                after = tokens[i + 1][0]
                row.append(f"after={after if not after[0].isalnum() else 'word'}")
            features.append(row)
        out.append(Window(tokens, features))
    return out


class Field:
    """Weights by feature and tag, and of tags that follow each other; a secret cannot go on before it begins."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.follow = np.zeros((3, 3))
        self.follow[OUTSIDE, INSIDE] = -1e6

    def scores(self, features: list[list[str]]) -> np.ndarray:
        none = np.zeros(3)
        return np.array([sum((self.weights[f] for f in row if f in self.weights), none) for row in features])

    def fit(self, windows: list[Window], tags: list[list[int]], epochs: int = EPOCHS, rate: float = 0.3) -> Field:
        """Likelihood of the tags, by stochastic gradient with step sizes of its own for each weight."""
        for window in windows:
            for row in window.features:
                for name in row:
                    self.weights.setdefault(name, np.zeros(3))
        squares = {name: np.full(3, 1e-6) for name in self.weights}
        follow_squares = np.full((3, 3), 1e-6)
        for _ in range(epochs):
            for window, wanted in zip(windows, tags, strict=True):
                single, pairs = self.marginals(self.scores(window.features))
                slope = -single
                slope[np.arange(len(wanted)), wanted] += 1
                for row, g in zip(window.features, slope, strict=True):
                    if np.abs(g).max() < 1e-4:
                        continue
                    for name in row:
                        squares[name] += g * g
                        self.weights[name] += rate * g / np.sqrt(squares[name])
                seen = np.zeros((3, 3))
                np.add.at(seen, ([OUTSIDE, *wanted[:-1]], wanted), 1)
                g = seen - pairs
                g[OUTSIDE, INSIDE] = 0
                follow_squares += g * g
                self.follow += rate * g / np.sqrt(follow_squares)
        return self

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each token's tag, and expected counts of tags that follow each other."""
        n = len(scores)
        move = np.exp(np.maximum(self.follow, -700))
        local = np.exp(scores - scores.max(axis=1, keepdims=True))
        ahead = np.zeros((n, 3))
        back = np.ones((n, 3))
        before = np.array([0.0, 0.0, 1.0])
        for i in range(n):
            before = (before @ move) * local[i]
            before /= before.sum()
            ahead[i] = before
        for i in range(n - 2, -1, -1):
            back[i] = move @ (local[i + 1] * back[i + 1])
            back[i] /= back[i].sum()
        single = ahead * back
        single /= single.sum(axis=1, keepdims=True)
        left = np.vstack(([[0.0, 0.0, 1.0]], ahead[:-1]))
        pairs = left[:, :, None] * move[None] * (local * back)[:, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        return single, pairs.sum(axis=0)

    def decode(self, scores: np.ndarray) -> list[int]:
        """The best tags, by Viterbi, in front of and behind which everything is outside."""
        best = np.array([-1e9, -1e9, 0.0])
        steps = []
        for row in scores:
            ways = best[:, None] + self.follow
            came = ways.argmax(axis=0)
            best = ways[came, range(3)] + row
            steps.append(came)
        tag = int(best.argmax())
        tags = [tag]
        for came in reversed(steps[1:]):
            tag = int(came[tag])
            tags.append(tag)
        return tags[::-1]


def tags_of(window: Window, secrets: list[tuple[int, int]]) -> list[int]:
    tags, open_secret = [], None
    for _, start, end in window.tokens:
        inside = next((s for s in secrets if s[0] <= start and end <= s[1]), None)
        tags.append(OUTSIDE if inside is None else INSIDE if inside == open_secret else BEGIN)
        open_secret = inside
    return tags


def train(documents: DataFrame, text_col: str = "text", most_documents: int = TRAIN_DOCUMENTS) -> Field:
    """A field fitted on the documents of smallest hash that have something unusual; rules give the labels."""
    unusual = r"[A-Za-z]*[0-9][A-Za-z0-9]{5,}|[A-Za-z0-9]{20,}"
    texts = documents.select(F.col(text_col).cast("string").alias("text"))
    # Hashes alone are ranked, so that no task sends texts; then each different text of the smallest ones comes once.
    prints = texts.filter(F.col("text").rlike(unusual)).select(F.xxhash64("text").alias("print")).distinct()
    last = prints.orderBy("print").limit(most_documents).agg(F.max("print")).first()[0]
    if last is None:
        return Field()
    near = texts.withColumn("print", F.xxhash64("text")).filter((F.col("print") <= last) & F.col("text").rlike(unusual))
    rows = near.groupBy("print").agg(F.min("text").alias("text")).orderBy("print").collect()
    windows: list[Window] = []
    tags: list[list[int]] = []
    for row in rows:
        if len(windows) >= TRAIN_WINDOWS:
            break
        secrets = [(inner, end) for _, _, end, inner in rule_spans(row.text)]
        for window in windows_of(row.text):
            windows.append(window)
            tags.append(tags_of(window, secrets))
    return Field().fit(windows, tags)


class SecretScanner:
    def __init__(self, field: Field):
        self.field = field

    def model_spans(self, text: str, taken: list[tuple[int, str, int, int]]) -> list[tuple[int, str, int, int]]:
        out = []
        for window in windows_of(text):
            tags = self.field.decode(self.field.scores(window.features))
            spans: list[list[int]] = []
            for tag, (_, start, end) in zip(tags, window.tokens, strict=True):
                if tag == BEGIN:
                    spans.append([start, end])
                elif tag == INSIDE and spans:
                    spans[-1][1] = end
            out += [
                (start, "model", end, start)
                for start, end in spans
                if end - start >= LEAST_SECRET and not any(start < t[2] and t[0] < end for t in taken)
            ]
        return out

    def __call__(self, text: str):
        base = rule_spans(text)
        spans = sorted(base + self.model_spans(text, base), key=lambda s: (s[0], [*KINDS, "model"].index(s[1])))
        counts = [sum(s[1] == kind for s in base) for kind in KINDS]
        digest = hashlib.sha256(",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in base).encode()).hexdigest()
        return *counts, digest, [{"kind": kind, "start": start, "end": end} for start, kind, end, _ in spans]


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per document: what the rules find, and all spans in characters, the end not included."""
    held = documents.sparkSession.sparkContext.broadcast(field or train(documents, text_col))
    return scan_rows(documents, [id_col], text_col, FOUND, lambda: SecretScanner(held.value), as_bytes=False)


def op2_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    found = scan_secrets(table(spark, root, "documents"))
    written = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return found.withColumn("spans", F.concat_ws(",", written))
