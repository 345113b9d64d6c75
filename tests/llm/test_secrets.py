import random
import re

import pytest

from textquarry.llm import secrets

PLAIN = {
    "assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}


def plain_spans(text):
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


def test_spans_equal_those_of_a_plain_scan(spark, make):
    rng = random.Random(4)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "  ", "'", '"', "AKIA", "ABCDEFGH12345678", "x.y-z/1234567",
            "0123456789abcdef", "dead", "é", "😀", "\n", "short", "A", "==", "f" * 40]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(400)]
    got = {r.doc_id: r.found for r in secrets.find_secrets(make(rows)).collect()}
    for i, text in rows:
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in got[i] if s.rank < 3)
        assert base == plain_spans(text)
    assert sum(map(len, got.values())) > 300


def test_a_text_of_very_many_secrets(spark, make):
    text = "0123456789abcdef é " * 30_000
    (row,) = secrets.find_secrets(make([(1, text)])).collect()
    assert [s.start for s in row.found] == list(range(0, 19 * 30_000, 19))


@pytest.mark.parametrize("pattern, want", [
    (r"AKIA[A-Z0-9]+", [{"aki", "kia"}]),
    (r"[0-9a-f]{16,}", []),
    (r"(abc|xyz)+d", [{"abc"}, {"xyz"}]),
    (r"ab?cde", [{"abc", "bcd", "cde"}, {"acd", "cde"}]),
    (r"x.*long[12]y", [{"lon", "ong", "ng1", "g1y"}, {"lon", "ong", "ng2", "g2y"}]),
    (r"(?:abc)?", []),
])
def test_trigram_queries(pattern, want):
    got = secrets.trigram_query(pattern)
    assert sorted(map(sorted, got)) == sorted(map(sorted, want))


def test_queries_never_miss_a_match():
    """Every text that a rule matches fulfils the rule's query."""
    rng = random.Random(2)
    for rule in secrets.BASE_RULES + secrets.MORE_RULES:
        query = secrets.trigram_query(rule.pattern)
        for _ in range(3000):
            text = "".join(rng.choice(["api", "_", "key", "=", "ghp_", "A" * 36, "AKIA", "eyJ", ".", "://", "a:b@", "token", ":", "KEY"]) for _ in range(8))
            if query and re.search(rule.pattern, text):
                assert any(all(t in text.lower() for t in every) for every in query)


def test_plan_has_no_python(spark, make):
    plan = secrets.report(make([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
