import hashlib
import random
import re

from lexmatch.llm import secrets as s

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}
WEAK = {
    "identifier": (re.compile(r"""(?i:username|user_name|user_id|userid|login|client_id|clientid|account_id|accountid|tenant_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]+""", re.ASCII), lambda m: True),
    "mixed": (re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"), lambda m: bool(re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9].*[0-9]", m[0]))),
    "endpoint": (re.compile(r"""(?i:https?)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?i:hostname|host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+""", re.ASCII), lambda m: True),
}


def found(text, kinds):
    return [(k, m.start(), m.end()) for k, (pattern, good) in kinds.items() for m in pattern.finditer(text or "") if good(m)]


def brute(text, scope):
    base, weak = found(text, BASE), found(text, WEAK)
    out = list(base)
    for k, a, b in weak:
        near = [x for x in base + weak if x[0] != k and max(a, x[1]) - min(b, x[2]) <= scope]
        who, what = any(x[0] in ("access", "identifier") for x in near), any(x[0] in ("assign", "hex", "mixed") for x in near)
        over = any(x[0] in BASE and max(a, x[1]) < min(b, x[2]) for x in near)
        if not over and {"identifier": what, "mixed": who, "endpoint": who and what}[k]:
            out.append((k, a, b))
    order = lambda x: (x[1], s.ORDER.index(x[0]))
    return sorted(base, key=order), sorted(out, key=order)


def texts():
    r = random.Random(2)
    mixed = lambda: "".join(r.choice("abcXYZ0123456789+/") for _ in range(24)) + "aA11"
    part = [
        lambda: f"password = '{r.choice(['short', 'longenough1', 'é'])}'", lambda: "AKIA" + "ABCD1234" * r.randint(0, 2), lambda: "0123456789abcdef" * r.randint(1, 3), mixed, lambda: "user_name: " + r.choice(["bob", "Ann.B"]),
        lambda: "https://api.example.org/v1?x=1", lambda: "HOST=db.internal", lambda: "plain words é日 here " * r.randint(1, 30), lambda: "\n", lambda: "secret: token : abcdefghi", lambda: "API_KEY=TOKEN=abcdefgh", lambda: "paſſword=longenough ToKen=\"aaaaaaaaa", lambda: "client_id=" + mixed(),
    ]
    rows = ["".join(r.choice(part)() + r.choice([" ", "", "\n"]) for _ in range(r.randint(0, 14))) for _ in range(150)]
    return [*rows, None, "", "token=abcdefgh", "x" * 300_000 + " login=me " + mixed(), "login=a " * 2000 + mixed()]


def test_scan_equals_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "token=abcdefgh", "x"), (3, None, "x"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(x) for x in s.report(s.scan(docs)).collect()), key=str)
    want = []
    for i, t, _ in rows:
        base, spans = brute(t, s.SCOPE)
        write = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
        want.append((i, *[sum(x[0] == k for x in base) for k in s.BASE], hashlib.sha256(write(base).encode()).hexdigest(), write(spans)))
    assert got == sorted(want, key=str)
    assert sum("mixed" in x[5] for x in got) > 5 and sum("endpoint" in x[5] for x in got) > 5


def test_weak_parts_alone_are_not_reported(spark):
    rows = [(1, "see https://example.org and user_name: bob"), (2, "aB3" * 10), (3, "login: bob " + " " * 300 + "aB3" * 10), (4, "login: bob " + "aB3" * 10)]
    got = {x["doc_id"]: x["spans"] for x in s.report(s.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "identifier:0:10,mixed:11:41"}


def test_redact(spark):
    rows = [(i, t, i, "y") for i, t in enumerate(texts())] + [(None, "a token=abcdefgh b", 1, "y"), (7, "x token=abcdefgh", 1, "y"), (7, "x token=abcdefgh", 1, "y"), (7, None, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 int, _key string")
    got = sorted((tuple(x) for x in s.redact(docs).collect()), key=str)
    want = []
    for i, t, *rest in rows:
        marked, last, parts = t, 0, []
        if t is not None and (spans := brute(t, s.SCOPE)[1]):
            for _, a, b in spans:
                if a >= last:
                    parts += [t[last:a], "[SECRET]"]
                last = max(last, b)
            marked = "".join(parts) + t[last:]
        want.append((i, marked, *rest))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert s.report(s.scan(none)).isEmpty() and s.redact(none).isEmpty()
