"""The secret scan against an independent one in plain Python, and on very long candidates."""

import hashlib
import math
import random
import re
from collections import Counter

from loomfact.llm import secrets

# ---- fixed values: the base patterns, as the contract gives them
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
BASE = (("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        v = m[0]
        if not re.search("[0-9]", v) or not re.search("[A-Za-z]", v) or re.fullmatch(r"/?([A-Za-z]*|[0-9]*)([-_/=]([A-Za-z]*|[0-9]*))*", v):
            continue
        if any(re.search(p, v) for p in secrets.ALLOWED):
            continue
        least = next(t for _, p, t in secrets.CLASSES if re.search(p, v))
        spans: list[list[int]] = []
        for at in range(len(v) - 19):
            counts = Counter(v[at : at + 20]).values()
            if math.log2(20) - sum(c * math.log2(c) for c in counts) / 20 >= least:
                if spans and spans[-1][1] >= at:
                    spans[-1][1] = at + 20
                else:
                    spans.append([at, at + 20])
        out += [(m.start() + a, m.start() + z) for a, z in spans]
    return out


def brute(text: str | None) -> tuple:
    text = text or ""
    base, counts = [], []
    for rank, (_, pattern, group, least) in enumerate(BASE):
        own = [(m.start(), rank, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
        counts.append(len(own))
        base += own
    more = [(a, 3, z) for a, z in entropy_spans(text) if not any(s <= a and e >= z for s, _, e in base)]
    named = lambda spans: ",".join(f"{secrets.KINDS[r]}:{s}:{e}" for s, r, e in sorted(spans))
    return (*counts, len(more), hashlib.sha256(named(base).encode()).hexdigest(), named(base + more))


def texts() -> list[str | None]:
    rng = random.Random(7)
    bits = ["password=", "Api_Key: '", "token =", "secret\":\"", "AKIA", "0123456789abcdef", "deadbeef", "example", "a-1-", "héé", " ", "\n", "=", "--", "𝛼", "sha256-", "xxxxxxx", "zz9"]
    alphabet = "ABCDEFabcdef0123456789xyzXYZ+/_=.-"
    made: list[str | None] = [None, "", "a-1-" * 2000, "-" * 9000, "0" * 5000]
    for _ in range(400):
        parts = [rng.choice(bits) if rng.random() < 0.5 else "".join(rng.choices(alphabet, k=rng.choice([3, 12, 20, 30, 60]))) for _ in range(rng.randrange(1, 30))]
        made.append("".join(p + rng.choice(["", " ", "", ","]) for p in parts))
    return made


def test_scan_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.n_entropy, r.base_sha256, r.spans) for r in got}
    assert len(found) == len(rows)
    for i, t in rows:
        assert found[i] == brute(t), t
    assert sum(f[3] > 0 for f in found.values()) > 50


def test_redaction_cuts_the_same_spans(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.text for r in secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string"), "\0").collect()}
    for i, t in rows:
        spans = sorted((int(a), int(z)) for _, a, z in (s.split(":") for s in brute(t)[-1].split(",") if s))
        merged: list[list[int]] = []
        for a, z in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        want, at = [], 0
        for a, z in merged:
            want += [t[at:a], "\0"]
            at = z
        assert got[i] == (None if t is None else "".join(want) + t[at:]), t


def test_very_long_candidates(spark):
    rng = random.Random(3)
    mixed = "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=200_000))
    long = ["a-1-" * 250_000, "-" * 1_000_000, "0123456789abcdef" * 60_000, mixed, "0123456789abcdef " * 20_000, "password=abcdefabcdef12 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert (got[0].n_assign, got[0].n_hex, got[1].spans) == (0, 0, "")
    assert (got[2].n_hex, got[4].n_hex, got[5].n_assign) == (1, 20_000, 20_000)
    assert got[3].n_entropy > 0
    short = {r.doc_id: len(r.text) for r in secrets.redacted(docs).collect()}
    assert short[1] == 1_000_000 and short[5] == 20_000 * len("[SECRET] ")
