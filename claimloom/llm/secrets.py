"""Secret scans: spans of credentials in whole texts, separated by how widely their values are owned.

Each text is scanned for three fixed kinds (BASE) and for further ones (MORE): wider names of assignments, issuers' own
formats, signed tokens, private keys, passwords in addresses and free-standing keys. Every span's value is hashed. Over
the whole corpus the hashes are counted by distinct repositories and distinct owners: a value in more than MAX_OWNERS
owners or MAX_REPOSITORIES repositories is a copied example; one that few hold and that looks like a live credential (no
placeholder, varied characters) is live. Spans of the further kinds are reported if they are live; base spans always are.

Scans run row by row in Arrow batches and leave hashes alone; counts go from (hash, owner, repository) to (hash, owner) to
hash with map-side sums, and return to the spans by spread_join, so no hot value meets one task.

Cases: a null or empty text has no spans; a null owner or repository is one of its own (all nulls together); rows that
repeat an id are documents of their own, but of one repository; empty tables give no rows; a span of a further kind that
overlaps a base span, one of an earlier kind or an earlier one is left out; other columns are ignored. Scans take time in
proportion to the text."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import load, map_texts, materialize, spread_join

#: The kinds that every scan reports, with the group that holds the value and its least number of characters.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Further kinds: name, parts of which (lower-cased) a text must hold one, pattern, group of the value, least entropy of the value in bits a character.
MORE = (
    ("pem", ("private key",), re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )?PRIVATE KEY-----"), 1, 3.0),
    ("jwt", ("eyj",), re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 3.5),
    ("issued", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "aiza", "asia", "npm_", "pypi-", "sg.", "hf_", "sk-", "ya29.", "dop_v1_", "shpat_"), re.compile(
        r"(?<![A-Za-z0-9_-])(?:gh[opusr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{20,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|ASIA[A-Z0-9]{16}"
        r"|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|hf_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{32,}|ya29\.[A-Za-z0-9_-]{20,}|dop_v1_[0-9a-f]{64}|shpat_[0-9a-fA-F]{32})(?![A-Za-z0-9_-])"), 0, 3.0),
    ("address", ("://",), re.compile(r"://[^\s:/@\"'<>]+:([^\s:/@\"'<>]{6,})@[A-Za-z0-9]"), 1, 2.5),
    ("named", ("pwd", "passphrase", "credential", "private", "access", "auth", "signing", "encryption"), re.compile(
        r"""(?:pwd|passphrase|credentials?|(?:private|access|auth|signing|encryption)[_-]?key)["']?\x20*[:=]>?\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.ASCII | re.IGNORECASE), 1, 2.5),
    ("key", (), re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9_-]{28,}(?![A-Za-z0-9+/_=.-])"), 0, 3.3),
)
KINDS = tuple(kind for kind, *_ in BASE + MORE)

#: Beyond these numbers of owners and repositories a value counts as a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 16
#: Parts of values that nobody uses in earnest.
PLACEHOLDERS = ("example", "placeholder", "changeme", "change_me", "dummy", "sample", "your", "insert", "redacted", "xxxx", "****", "....", "0000", "1234", "abcd", "test", "fake", "secret", "password", "token")

SPAN = "struct<kind: int, start: int, stop: int, value: string, lively: boolean>"


def entropy(value: str) -> float:
    """Bits a character of the characters' frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str, bits: float) -> bool:
    """No placeholder, letters and digits (at least three), varied characters, no plain words between hyphens or underscores."""
    low = value.lower()
    digits = sum(map(value.count, "0123456789"))
    if digits < 3 or digits == len(value) or any(p in low for p in PLACEHOLDERS) or entropy(value) < bits:
        return False
    pieces = [p for p in re.split("[_-]", value) if p]
    return sum(p.isalpha() and (p.islower() or p.istitle()) for p in pieces) * 2 <= len(pieces)


def digest(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def base_spans(text: str, low: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, stop, value) of the base kinds' matches that are long enough, by start, then kind."""
    out = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        if kind == 0 and not any(name in low for name in NAMES) or kind == 1 and "AKIA" not in text:
            continue
        out += [(m.start(), kind, m.end(), m.group(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


class _Taken:
    """Stretches of a text that spans hold; later ones are added in order of their start, kind by kind."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.stops = [], []
        for start, stop in sorted(spans):  # base spans of different kinds may overlap
            if self.stops and start < self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], stop)
            else:
                self.starts.append(start)
                self.stops.append(stop)

    def free(self, start: int, stop: int) -> bool:
        return bisect_left(self.starts, stop) == bisect_right(self.stops, start)

    def joined(self, spans: list[tuple[int, int]]) -> _Taken:
        return _Taken([*zip(self.starts, self.stops, strict=True), *spans])


def scan_text(text: str | None) -> tuple[int, int, int, str, list[dict]]:
    """n_assign, n_access, n_hex, base_sha256 and all spans of a text, base ones first, each with its value's hash and
    whether it looks live."""
    text = text or ""
    low = text.lower()
    base = base_spans(text, low)
    named = ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop, _ in base)
    counts = Counter(kind for _, kind, _, _ in base)
    spans = [{"kind": kind, "start": start, "stop": stop, "value": digest(value), "lively": looks_live(value, 2.5)} for start, kind, stop, value in base]
    taken = _Taken([(start, stop) for start, _, stop, _ in base])
    for kind, (_, stems, pattern, group, bits) in enumerate(MORE, start=len(BASE)):
        if stems and not any(stem in low for stem in stems):
            continue
        new = []
        for m in pattern.finditer(text):
            if taken.free(*m.span()) and looks_live(m.group(group), bits):
                new.append(m.span())
                spans.append({"kind": kind, "start": m.start(), "stop": m.end(), "value": digest(m.group(group)), "lively": True})
        if new:
            taken = taken.joined(new)
    return counts[0], counts[1], counts[2], hashlib.sha256(named.encode()).hexdigest(), spans


def _scans(texts: list[str | None]) -> list[list]:
    return [list(x) for x in zip(*map(scan_text, texts))] or [[] for _ in range(5)]


def ownership(found: DataFrame) -> DataFrame:
    """n_owners, n_repositories and n (rows) of every value; found has value, owner, repository. Nulls count as one."""
    rows = found.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = rows.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n"))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", owner: Column | None = None, repository: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """(documents, findings). Documents: the columns keep of every row, row, n_assign, n_access, n_hex and base_sha256.
    Findings: row, kind, start, stop, value (hash), lively, n_owners, n_repositories and state of every candidate; state is
    live, copied or weak. By default the owner is the source and the repository the document."""
    owner = F.col("source") if owner is None else owner
    repository = F.col("doc_id") if repository is None else repository
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"), owner.cast("string").alias("__owner"), repository.cast("string").alias("__repository"), F.monotonically_increasing_id().alias("row"))
    fields = f"n_assign long, n_access long, n_hex long, base_sha256 string, __spans array<{SPAN}>"
    done = materialize(map_texts(rows, "__text", fields, lambda: _scans, [*keep, "row", "__owner", "__repository"]), "secret-spans")
    found = done.select("row", F.col("__owner").alias("owner"), F.col("__repository").alias("repository"), F.explode("__spans").alias("s")).select("row", "owner", "repository", "s.*")
    known = spread_join(found.drop("owner", "repository"), ownership(found), "value")
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories)
    state = F.when(copied, "copied").when(F.col("lively"), "live").otherwise("weak")
    return done.drop("__spans", "__owner", "__repository"), known.withColumn("state", state)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns, spans (all base ones and the live others), and how many spans are live, copied and weak."""
    docs, found = scan(load(spark, sf_dir, "documents"), ["doc_id"])
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    shown = (F.col("kind") < len(BASE)) | (F.col("state") == "live")
    span = F.when(shown, F.struct("start", "kind", F.concat_ws(":", name, "start", "stop").alias("named")))
    count = lambda state: F.count(F.when(F.col("state") == state, 1)).alias(f"n_{state}")
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"), count("live"), count("copied"), count("weak"))
    out = docs.join(by_row, "row", "left")
    spans = F.array_join(F.transform(F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,named:string>>")), lambda s: s["named"]), ",")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_live", "n_copied", "n_weak")]
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), *zero)
