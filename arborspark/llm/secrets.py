"""Secret scanning: patterns propose candidates, a random forest removes false positives.

Candidates are values assigned to names that speak of secrets, private key blocks from their first line to their last, and
long runs of key characters that hold a digit or change case as no word does. The forest judges each by its length,
character transitions, dictionary coverage, the path it was found under and the neighbouring words. Transitions and
coverage go by a dictionary of the corpus: its ``VOCABULARY`` most frequent words, counted over all documents. The forest is
trained from labelled findings, given as rows or as a table; ``labelled_findings`` makes a bounded, seeded set of them where
no table holds any.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, release, spread

FINDINGS, TREES, DEPTH, TRY, THRESHOLD, AROUND, VOCABULARY, LABELLED = 4000, 40, 9, 6, 0.5, 48, 20_000, 100_000

_RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}")
_CHANGE = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
_ASSIGNED = re.compile(r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s{0,3}(?:=>|=|:)\s{0,3}[\"']?([^\s\"',;<>]{6,})")
#: A key from its first line over header lines and lines of any number (line ends may be escaped) to its last line, or to where such lines end.
_PRIVATE = re.compile(
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:\s|\\[rn]|[\"',+](?=\s|\\|[\"'])|(?:Proc-Type|DEK-Info|Comment|Version|Hash|Charset):[^\n\\]{0,200}|[A-Za-z0-9+/=]{16,})*+"
    r"(?:(?:[A-Za-z0-9+/=]{1,15}(?:\s|\\[rn]|[\"',+])*+)?-----END [A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----)?"
)

# fixed values: words that stand near secrets and near harmless look-alikes, prefixes of issued keys, common English words
_NEAR = "password passwd pwd secret token apikey api_key api-key access_key auth authorization bearer credential private key login".split()
_HARMLESS = "sha sha1 sha256 md5 hash commit checksum digest uuid guid etag revision version build id ref example sample dummy test placeholder color isbn serial session".split()
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-", "-----BEGIN")
_WORDS = (
    "the and for that with this from have not are was but all can you your has had will one our out use get set new key value name data file user path time type list item page text test code "
    "main load save read write open close start stop begin end next last first order count total index table column row string number object class function method return error message config server "
    "client request response session access public private local remote default sample example token secret password change place holder enter here your-key build version release branch commit "
    "image video audio style script button label field form input output result state event action handler service module package import export random hash digest content header footer"
).split()
_TEST_PATH = re.compile(r"(?i)test|spec|fixture|example|sample|mock|docs?/|readme")
_CONFIG_PATH = re.compile(r"(?i)\.env|config|settings|credential|\.ya?ml|\.ini|\.pem|\.toml|deploy")


class Dictionary:
    """Words of the corpus: which stretches of a value are words, and how likely a letter follows a letter in them."""

    def __init__(self, words: list[str] = ()):
        known = {w for w in (*words, *_WORDS) if len(w) > 2}
        self.words, self.longest = known, max(map(len, known))
        c = np.full((26, 26), 0.3)
        for w in known:
            low = [ord(x) - 97 for x in w if "a" <= x <= "z"]
            for a, b in zip(low[:-1], low[1:], strict=True):
                c[a, b] += 1
        self.flow = np.log(c / c.sum(1, keepdims=True))

    def covered(self, letters: str) -> int:
        """How many characters the longest words from the left cover."""
        at = total = 0
        n, words = len(letters), self.words
        while at < n - 2:
            for k in range(min(self.longest, n - at), 2, -1):
                if letters[at : at + k] in words:
                    total += k
                    at += k
                    break
            else:
                at += 1
        return total


def learn_dictionary(docs: DataFrame, text_col: str = "text", limit: int = VOCABULARY) -> Dictionary:
    """The limit most frequent words (3 to 15 letters, lower-cased) of all texts; ties go by the word. Null texts have none.

    What the driver gets is bounded: a histogram of the counts (eight steps to a doubling) shows from which step on there are
    enough words, and only those of that step and above are ranked.
    """
    words = spread(docs.select(docs[text_col].cast("string").alias("t"))).select(F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("w"))
    words = words.where(F.length("w").between(3, 15)).groupBy("w").agg(F.count("*").alias("n"))
    words = cut(words.withColumn("step", F.floor(F.log2("n") * 8).cast("int")))
    least, have = 0, 0
    for step, n in sorted(((r["step"], r["count"]) for r in words.groupBy("step").count().collect()), reverse=True):
        least, have = step, have + n
        if have >= limit:
            break
    found = [r["w"] for r in words.where(F.col("step") >= least).orderBy(F.desc("n"), "w").limit(limit).collect()]
    release(words)
    return Dictionary(found)


_LETTERS = re.compile(r"[^\W\d_]{3,}")
_KIND = np.full(128, 3, np.uint8)
_KIND[48:58], _KIND[97:123], _KIND[65:91] = 0, 1, 2


def features(before: str, value: str, after: str, path: str, dictionary: Dictionary) -> list[float]:
    """What the forest looks at, of the whole value."""
    n, low = len(value), value.lower()
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[np.minimum(code, 127)]
    counts = np.bincount(kind, minlength=4) / n
    chars = np.unique(code, return_counts=True)[1] / n
    letters = np.frombuffer(low.encode("ascii", "ignore"), np.uint8)
    letters = letters[(letters >= 97) & (letters <= 122)].astype(np.int64) - 97
    flow = float(dictionary.flow[letters[:-1], letters[1:]].mean()) if len(letters) > 1 else -3.3
    step = np.diff(code.astype(np.int64))
    near = before[-AROUND:].lower()
    words = set(re.findall(r"[a-z0-9_-]+", near + " " + after[:AROUND].lower()))
    return [
        math.log(n), *counts.tolist(), float((kind[1:] != kind[:-1]).sum()) / n, len(chars) / n, -float((chars * np.log2(chars)).sum()), flow,
        sum(dictionary.covered(m) for m in _LETTERS.findall(low)) / n, float(((step == 0) | (step == 1)).sum()) / n,
        float(all(c in "0123456789abcdefABCDEF-" for c in value)), float(re.search(r"[=:]\s*[\"']?$", before[-6:]) is not None), float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before) and bool(after)),
        float(any(w in near for w in _NEAR)), float(any(w in words for w in _HARMLESS)), float(value.startswith(_PREFIXES)), float(bool(_TEST_PATH.search(path))), float(bool(_CONFIG_PATH.search(path))),
        sum(map(low.count, "aeiou")) / n,
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the candidates, without overlaps: private keys, then assigned values, then runs; the earlier and longer of a kind stands.

    A run that holds an assigned value (``name=value`` without blanks) gives way to it.
    """
    kinds = [[m.span() for m in _PRIVATE.finditer(text)] if "-----BEGIN" in text else [], [m.span(1) for m in _ASSIGNED.finditer(text)], []]
    for m in _RUN.finditer(text):
        value = m.group()
        if any(c in value for c in "0123456789") or len(_CHANGE.findall(value)) >= 4:
            kinds[2].append(m.span())
    out: list[tuple[int, int]] = []
    for found in kinds:
        for s, e in found:
            i = bisect_left(out, (s, e))
            if not (i and out[i - 1][1] > s or i < len(out) and out[i][0] < e):
                out.insert(i, (s, e))
    return out


def labelled_findings(n: int = FINDINGS, seed: int = 3) -> list[tuple[str, str, str, str, int]]:
    """(before, value, after, path, label) of n findings, half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    prose = lambda: " ".join(pick(_WORDS) for _ in range(int(rng.integers(1, 6)))) + " "
    paths = ["src0", "src3", "app/config.yaml", "deploy/.env", "tests/test_login.py", "docs/readme.md", "lib/main.py", "web/index.html", ""]
    out = []
    for i in range(n):
        path, quote = pick(paths), pick(['"', "'", ""])
        if i % 2:
            kind = int(rng.integers(9))
            value = [
                lambda: chars(hexa, int(pick([32, 40, 40, 40, 48, 64]))),
                lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16),
                lambda: pick(["ghp_", "glpat-", "sk_live_", "xoxb-"]) + chars(alnum, int(rng.integers(20, 40))),
                lambda: "eyJ" + chars(b64[:62], int(rng.integers(30, 120))),
                lambda: chars(b64, int(rng.integers(20, 60))) + pick(["", "=", "=="]),
                lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(chars(b64, 64) for _ in range(int(pick([2, 5, 12, 40])))) + pick(["", "\n-----END RSA PRIVATE KEY-----"]),
                lambda: chars(alnum + "!@#$%^&*", int(rng.integers(8, 20))),
                lambda: chars(string.ascii_letters, int(rng.integers(32, 64))),
                lambda: chars(alnum, int(pick([24, 32, 36, 40, 64]))),
            ][kind]()
            name = pick(["token", "api_key", "secret", "password", "auth_token", "access_key", "SECRET_KEY", "apikey", "client_secret"])
            if kind == 5 or kind in (1, 2, 3, 7, 8) and rng.random() < 0.4:
                before, after = prose(), " " + prose()
            else:
                before, after = f"{prose()}{name}{pick([' = ', '=', ': ', '=> '])}{quote}", quote + pick(["\n", " ", " " + prose()])
        else:
            kind = int(rng.integers(11))
            value = [
                lambda: chars("0123456789", int(rng.integers(16, 24))),
                lambda: "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)),
                lambda: chars(hexa, int(pick([32, 40, 64]))),
                lambda: "_".join(pick(_WORDS) for _ in range(int(rng.integers(3, 6)))) + chars("0123456789", 2),
                lambda: pick(["your", "my", "change", "enter"]) + "-" + "-".join(pick(_WORDS) for _ in range(3)) + pick(["", "123", "1"]),
                lambda: pick(["0123456789abcdef", "1234567890123456", "abcdefghijklmnop1", "xxxxxxxxxxxxxxxx1", "a1" * 9]),
                lambda: "/".join(pick(_WORDS) for _ in range(4)) + chars("0123456789", 1),
                lambda: chars("aeiourtnslch", int(rng.integers(14, 24))) + chars("0123456789", 2),
                lambda: pick(["true", "none-given", "required", "<token>", "${TOKEN}", "process.env", "undefined", "example", "changeme", "optional,", "string", "function()"]) + pick(["", "()", "."]),
                lambda: "".join(pick(_WORDS).capitalize() for _ in range(int(rng.integers(5, 9)))),
                lambda: pick("abxz0-=_") * int(rng.integers(20, 300)) + pick(["", "1", "9"]),
            ][kind]()
            if kind == 2 or rng.random() < 0.3:
                before, after = f"{prose()}{pick(['sha256', 'commit', 'checksum', 'md5', 'etag', 'revision', 'digest', 'build'])}{pick([' ', ': ', '='])}", " " + prose()
            elif kind in (4, 5, 8):
                before, after = f"{prose()}{pick(['token', 'password', 'api_key', 'secret'])}{pick([' = ', ': ', '='])}{quote}", quote + "\n"
            else:
                before, after = prose(), " " + prose()
        out.append((before, value, after, path, i % 2))
    return out


class Forest:
    """Binary random forest: bootstrap samples, random features at each node, Gini splits; leaves hold the share of ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, tried: int = TRY, seed: int = 9):
        rng = np.random.default_rng(seed)
        size = (1 << (depth + 1)) - 1
        self.depth = depth
        self.feature, self.cut, self.value = np.full((trees, size), -1, np.int64), np.zeros((trees, size)), np.full((trees, size), 0.5)
        for t in range(trees):
            todo = [(0, rng.integers(len(x), size=len(x)))] if len(x) else []
            while todo:
                node, rows = todo.pop()
                ones = y[rows].mean()
                self.value[t, node] = ones
                if 2 * node + 2 >= size or ones in (0.0, 1.0) or len(rows) < 6:
                    continue
                best = (np.inf, -1, 0.0)
                for f in rng.choice(x.shape[1], min(tried, x.shape[1]), replace=False):
                    v = x[rows, f]
                    order = np.argsort(v, kind="stable")
                    s, label = v[order], y[rows][order]
                    at = np.flatnonzero(s[1:] > s[:-1]) + 1
                    if not len(at):
                        continue
                    left = np.cumsum(label)[at - 1]
                    right, n = label.sum() - left, len(s)
                    gini = left * (1 - left / at) + right * (1 - right / (n - at))
                    k = int(gini.argmin())
                    if gini[k] < best[0]:
                        best = (float(gini[k]), int(f), float((s[at[k] - 1] + s[at[k]]) / 2))
                if best[1] < 0:
                    continue
                self.feature[t, node], self.cut[t, node] = best[1], best[2]
                low = x[rows, best[1]] <= best[2]
                todo += [(2 * node + 1, rows[low]), (2 * node + 2, rows[~low])]

    def score(self, x: np.ndarray) -> np.ndarray:
        total, all_rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                go = f >= 0
                high = x[all_rows, np.maximum(f, 0)] > self.cut[t, node]
                node = np.where(go, 2 * node + 1 + high, node)
            total += self.value[t, node]
        return total / max(1, len(self.feature))


class Judge:
    """A forest with the dictionary that its features go by."""

    def __init__(self, forest: Forest, dictionary: Dictionary):
        self.forest, self.dictionary = forest, dictionary

    def __call__(self, found: list[tuple[str, str, str, str]]) -> np.ndarray:
        return self.forest.score(np.array([features(*f, self.dictionary) for f in found]))


def train(findings: list | DataFrame, dictionary: Dictionary | None = None, limit: int = LABELLED, **options) -> Judge:
    """A judge from findings (before, value, after, path, label), as rows or as a table with these columns.

    Of a table at most limit rows are used, those with the smallest hashes. Nulls count as empty; findings without a value
    or a label are left out; no findings give a judge that is undecided.
    """
    if isinstance(findings, DataFrame):
        names = ["before", "value", "after", "path", "label"]
        findings = [tuple(r) for r in findings.select(*names).orderBy(F.xxhash64(*names)).limit(limit).collect()]
    dictionary = dictionary or Dictionary()
    good = [(*(x or "" for x in f[:4]), f[4]) for f in findings if f[1] and f[4] is not None]
    x = np.array([features(*f[:4], dictionary) for f in good or [("", "x", "", "", 0)]])[: len(good)]
    return Judge(Forest(x, np.array([f[4] for f in good], float), **options), dictionary)


def find(text: str, path: str, judge: Judge) -> list[tuple[int, int, float]]:
    """(start, end, score) of every candidate of a text, in characters."""
    spans = candidates(text)
    if not spans:
        return []
    score = judge([(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND], path) for s, e in spans])
    return [(s, e, float(p)) for (s, e), p in zip(spans, score, strict=True)]


def scan(docs: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_candidates, n_secrets, max_score, spans (start, end, score of the secrets, in characters) for each row.

    A null or empty text has no candidates (max_score 0), a null path counts as none, null ids stay, repeated rows are scanned
    each, a score of exactly the threshold is a secret, other columns are ignored, and an empty table gives an empty one. Texts
    are scanned whole, however long, and so is every candidate. No rows are shuffled.
    """
    bounded_batches(docs.sparkSession)
    source = spread(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[path_col].cast("string").alias("path")))
    kind = source.schema["id"].dataType.simpleString()
    sent = source.sparkSession.sparkContext.broadcast(judge)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            n, bad, top, spans = [], [], [], []
            for text, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = find(text or "", path or "", sent.value)
                hit = [{"start": s, "end": e, "score": p} for s, e, p in got if p >= threshold]
                n.append(len(got))
                bad.append(len(hit))
                top.append(max((p for _, _, p in got), default=0.0))
                spans.append(hit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(bad, pa.int64()), pa.array(top, pa.float64()), pa.array(spans, span)], ["id", "n_candidates", "n_secrets", "max_score", "spans"])

    out = source.mapInArrow(run, f"id {kind}, n_candidates long, n_secrets long, max_score double, spans array<struct<start:long,end:long,score:double>>")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, judge: Judge, text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD, mask: str = "[secret]") -> DataFrame:
    """docs with every secret replaced by mask; rows without one, and all other columns, stay as they are.

    A null text stays null, an empty one empty, a null path counts as none; repeated rows are cleaned each, names of other
    columns are free, and an empty table gives an empty one. No rows are shuffled.
    """
    bounded_batches(docs.sparkSession)
    at, path_at = docs.columns.index(text_col), docs.columns.index(path_col)
    sent = docs.sparkSession.sparkContext.broadcast(judge)

    def clean(text: str | None, path: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for s, e, p in find(text, path or "", sent.value):
            if p >= threshold:
                out += [text[last:s], mask]
                last = e
        return "".join([*out, text[last:]])

    def run(batches):
        for b in batches:
            text = pa.array([clean(t, p) for t, p in zip(b.column(at).to_pylist(), b.column(path_at).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([text if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)
