"""Secret scans against a text-by-text version, at several partitionings, and on forms that secrets take."""

import random
import re
import string

import numpy as np
import pytest

from lattica.llm import secret_scan

from .test_operators import prose, table

R = random.Random(31)


def secret(n=24, alphabet=string.ascii_letters + string.digits):
    return "".join(R.choice(alphabet) for _ in range(n))


DIGITS = secret(24, "0123456789") + "x"
FORMS = [
    'api_key: str = "{}"', 'const API_KEY: string = "{}"', "AWS_ACCESS_KEY_ID={}", 'GITHUB_TOKEN_V2 = "{}"', 'getenv("SECRET_KEY", "{}")', 'SECRET_KEY = b"{}"', 'access_token = f"{}"',
    "password for prod: {}", "<password>{}</password>", "we set the session token, " + "of which more is said in the other part " * 5 + "to {}", "Authorization: Bearer {}", "dbPassword={}", "tokens: ['{}', 'short']",
]
OTHERS = ["commit {} of the tree", "the tokenizer {} is", "The token. Then {} follows", "monkey = {}", "a key idea of {} is", "SECRETARY {}", "token\n{}"]


@pytest.mark.parametrize("form", FORMS)
def test_forms_that_are_reported(spark, form):
    value = secret()
    text = f"é {form.format(value)} and more"
    got = [(x["start"], x["length"]) for x in secret_scan.scan(table(spark, [(1, text, "a")]), dictionary=b"").collect()]
    assert got == [(text.index(value), 24)]


@pytest.mark.parametrize("form", OTHERS)
def test_forms_that_are_not(spark, form):
    assert secret_scan.scan(table(spark, [(1, form.format(secret()), "a")]), dictionary=b"").count() == 0


def test_key_blocks_lists_and_parts(spark):
    lines = [secret(64, string.ascii_letters + string.digits + "+/") for _ in range(3)]
    token = f"{secret(20)}.{secret(30)}.{secret(20)}"
    marks = "x9$kQ!vB7&zPq2#LmT4"
    text = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END RSA PRIVATE KEY-----\n" + f"id {secret(40)}\ntoken: {token}\npassword = {marks}\nsecrets = [{lines[0][:20]}, {lines[1][:20]}]"
    got = [text[x["start"] : x["start"] + x["length"]] for x in secret_scan.scan(table(spark, [(1, text, "a")]), dictionary=b"").orderBy("start").collect()]
    assert got == [*lines, token, marks, lines[0][:20], lines[1][:20]]


def brute(rows, dictionary):
    """One text at a time, by regular expressions over whole lines."""
    novelty, out = secret_scan.Novelty(dictionary), []
    core = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=(?i:api))|(?<=(?i:app))|(?<=(?i:bot))|(?<=(?i:db))|(?<=(?i:auth))|(?<=(?i:user))|(?<=(?i:access))|(?<=(?i:client))|(?<=(?i:session))|(?<=(?i:refresh)))"
    after = r"(?:(?<=[A-Z])S|s)?(?![a-z])(?!(?<=[A-Z])[A-Z])"
    sensitive = [
        re.compile(x)
        for x in (
            rf"{core}((?i:token|secret|pwd|credential|bearer|authorization|signature))(?={after})",
            rf"((?i:password|passwd|passphrase))(?={after})",
            rf"(?:(?i:api|access|secret|private|auth|client|account|session|master|service|signing|encryption|ssh)[_\-. ]?)((?i:key))(?={after})",
            rf"{core}((?i:key))(?=s?[\"'`\])]*[ \t]*(?:=>|[:=]))",
        )
    ]
    for i, t, _ in rows:
        if not t:
            continue
        raw = t.encode()
        inside = set()
        for m in re.finditer(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----((?:(?!\n\n|-----END).)*)", t, re.DOTALL):
            inside |= set(range(*m.span(1)))
        first = 0
        for line in t.split("\n"):
            found = []  # where names end: every start is tried, as names may overlap
            for p in range(len(line)):
                found += [(m.end(1), m[1].lower()) for m in (x.match(line, p) for x in sensitive) if m]
            found = sorted(set(found))
            used, told = None, -1
            for m in re.finditer(r"[!-~]+", re.sub(r"[\"'`()\[\]{}<>,;]", " ", line)):
                a, b = m.span()
                if b - a < secret_scan.MIN_CHARS:
                    continue
                p = re.match(r"(?:[A-Za-z_$][A-Za-z0-9_.$-]*(?:=>|:=|[:=])+)+", line[a:b])
                if p and b - a - p.end() >= secret_scan.MIN_CHARS:
                    a += p.end()
                while b - a > secret_scan.MIN_CHARS and line[b - 1] in ".:":
                    b -= 1
                name = "privatekey" if first + a in inside else None
                if name is None:
                    before = [x for x in found if x[0] <= a]
                    if not before or re.search(r"[.!?][ \t]", line[before[-1][0] : a]) or (before[-1] == used and not re.fullmatch(r"[ \t\"'`,;()\[\]{}<>]*", line[told:a])):
                        continue
                    used, told, name = before[-1], b, before[-1][1]
                at = len(t[: first + a].encode())
                added = novelty(line[a:b].encode(), raw[max(0, at - secret_scan.AROUND) : at], raw[at + b - a : at + b - a + secret_scan.AROUND])
                least = secret_scan.NOVELTY if re.search("[0-9]", line[a:b]) else secret_scan.WORDY_NOVELTY
                if added >= least * (b - a):
                    out.append((i, first + a, b - a, name, added))
            first += len(line) + 1
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for i in range(150):
        lines = []
        for _ in range(r.randrange(0, 6)):
            form = r.choice(FORMS + OTHERS)
            value = r.choice([secret(r.randrange(10, 60)), secret(40, "0123456789abcdef"), "your_api_key_here", "x" * 24, secret(20) + "." + secret(20) + ":", prose(r, 3).replace(" ", "_"), f"https://{prose(r, 1)}.example.com/{secret(8)}"])
            lines.append(r.choice(["", prose(r, r.randrange(1, 40)) + " é "]) + form.format(value) + r.choice(["", ".", " " + prose(r, 9), f" {secret(30)}"]))
        rows.append((i, "\n".join(lines), "a"))
    rows += [(1, "we set api_key =", "a"), (2, secret(), "a"), (3, "-----BEGIN PRIVATE KEY-----\n" + secret(64), "a"), (4, secret(64) + "\n-----END PRIVATE KEY-----", "a"), (5, "the api", "a"), (6, f"key {secret()}", "a"), (7, None, "a"), (8, "", "a")]
    return rows + [(9, "token " * 20_000 + secret(), "a"), (10, f"secret = {'ab12' * 30_000}", "a"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_brute_force_at_any_partitioning(spark, seed):
    rows = corpus(seed)
    docs = table(spark, rows).selectExpr("*", "1 AS start")
    words = secret_scan.identifier_dictionary(docs, min_docs=3)
    want = brute(rows, words)
    assert len(want) > 100 and {x[3] for x in want} > {"token", "key", "password", "privatekey"}
    for parts in (1, 3, 17):
        got = secret_scan.scan(docs.repartition(parts, "doc_id"), dictionary=secret_scan.identifier_dictionary(docs.repartition(parts), min_docs=3)).collect()
        assert sorted(((x["doc_id"], x["start"], x["length"], x["named"], x["added_bytes"]) for x in got), key=repr) == want


def test_dictionary_counts_documents(spark):
    rows = [(i, "alpha_beta alpha_beta gamma9delta xyz", "a") for i in range(5)] + [(9, "lonely words", "a"), (10, None, "a")]
    words = secret_scan.identifier_dictionary(table(spark, rows), min_docs=2).decode().split()
    assert words[-3:] == ["gamma", "delta", "alpha_beta"] and "lonely" not in words and "xyz" not in words


def test_candidates_of_a_tie_are_reported():
    raw = np.frombuffer(b"token = abcdefghijklmnop1\n", np.uint8)
    assert secret_scan.find(raw, np.array([0, len(raw)]), lambda *_: 9, 16, 9 / 17) != []
    assert secret_scan.find(raw, np.array([0, len(raw)]), lambda *_: 8, 16, 9 / 17) == []
