import math
import random
import re
from collections import Counter

import pytest
import zstandard

from strandloom.llm import secret_novelty as S

from .common import LONG, awkward, clashing, rows_of, sentence, table

def planted():
    rng = random.Random(11)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    base = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    secret = [f'token = "{hexes(40)}"', f"api_key: {base(32)}", f"password={base(24)}", f"Authorization: Bearer {base(48)}"]
    clean = ['token = "your_token_here_0000000000"', "password = changeme_changeme_changeme1", "secret key: AAAAAAAAAAAAAAAAAAAAAAAAAAAA1111", f"commit {hexes(40)}", "token of the unbelievablywonderfulness", f"card {rng.randrange(10**16)}"]
    rows = [(k, f"{sentence(rng)} {x} {sentence(rng)}") for k, x in enumerate(secret * 15 + clean * 15)]
    return [(i, t, "en", "s", None) for i, t in rows], {k for k in range(60)}

def test_planted_secrets_are_found_and_clean_text_is_not(spark):
    rows, truth = planted()
    found = {r.doc_id for r in S.scan(table(spark, rows)).collect()}

    assert len(found & truth) >= 0.95 * len(truth) and not found - truth

def plain_candidates(text):
    """Candidates by walking over characters: (start, end)."""
    words = [m.span() for m in re.finditer(S.KEYWORD, text, re.IGNORECASE | re.ASCII)]
    spans, last = [], 0
    for a, b in words:
        if a < last:
            continue
        at = b
        while at < len(text) and at - b < 64 and (text[at].isalnum() or text[at] in "_.-"):
            at += 1
        for tail in range(at, b - 1, -1):  # the name may end earlier
            k = tail
            while k < len(text) and k - tail < 2 and text[k] in "\"'`])}":
                k += 1
            while k < len(text) and text[k] in " \t":
                k += 1
            sign = next((x for x in ("=>", ":=", "==", ":", "=") if text.startswith(x, k)), None)
            if sign is None:
                continue
            k += len(sign)
            while k < len(text) and text[k] in " \t":
                k += 1
            start = k
            if k < len(text) and text[k] in "\"'`":
                end = k + 1
                while end < len(text) and text[end] != text[k] and not text[end].isspace():
                    end += 2 if text[end] == "\\" else 1
                if not (end < len(text) and text[end] == text[k] and end > k + 1):
                    continue
                start = k + 1
            else:
                end = k
                while end < len(text) and not text[end].isspace() and text[end] not in "\"'`,;<>(){}[]":
                    end += 1
                if end == k:
                    continue
            last = end
            if end - start >= 8:
                spans.append((start, end))
            break
    for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", text):
        before = [b for _, b in words if b <= m.start()]
        if before and m.start() - before[-1] <= 48:
            spans.append(m.span())
    kept = []
    for a, b in sorted(set(spans), key=lambda x: (x[0] - x[1], x[0])):
        run = text[a:b]
        kinds = [any(c.isdigit() for c in run), any(c.islower() for c in run), any(c.isupper() for c in run[1:]), any(not (c.isascii() and c.isalnum()) and (len(run) >= 16 or c not in "-_./:") for c in run.rstrip("="))]
        if sum(kinds) >= 2 and not any(a < d and c < b for c, d in kept):
            kept.append((a, b))
    return sorted(kept)


ODD = [
    'password = "hunter2!Xq9"', 'password="p@ssW0rd!!99xx##Zz"', "sk_token: sk.live.9f8a7b6c5d4e3f2a1b0c", '{"api_key" : "a-b_c.d/e+f=12345678"}', "pwd=short1", "secret => `x9$K2m!Qp7`", "token == abc1234567,next", "token=", "token", 'token="unclosed x1y2z3w4v5',
    "token=token=token=abcdef123456", "passwords.admin = 'it\\'s_4_secret'", "client secret value: zz11zz22zz33", "auth-key\t:\tAb3$Ab3$Ab3$", "bearer " + "ab12" * 6, "token " * 40 + "q1w2e3r4t5y6u7i8", "api key" + "=" * 30,
]


@pytest.mark.parametrize("text", [*ODD, " ".join(ODD), "\n".join(ODD)])
def test_candidates_are_those_of_a_plain_walk(text):
    assert [x[:2] for x in S.places(text, 48, 16, 8)] == plain_candidates(text)


def test_passwords_with_punctuation_are_found(spark):
    rng = random.Random(19)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!@#$%^&*.?"
    secret = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(10, 16)))
    shapes = ['password = "{}"', "pwd: {}", "db_password={}", '"passphrase": "{}"', "secret => '{}'"]
    rows = [(k, f"{sentence(rng)} {shapes[k % 5].format(secret())} {sentence(rng)}", "en", "s", None) for k in range(60)]
    words = ["changeme", "password1", "administrator", "example-token", "your_password", "configuration", "localhost:5432", "not-available"]
    rows += [(100 + k, f"{sentence(rng)} {shapes[k % 5].format(words[k % 8])} {sentence(rng)}", "en", "s", None) for k in range(40)]
    found = {r.doc_id for r in S.scan(table(spark, rows)).collect()}
    assert len([i for i in found if i < 60]) >= 54 and len([i for i in found if i >= 100]) <= 4


def test_prefilter_lets_every_sensitive_word_through():
    words = [f"{a}{b}{c}" for a in S._FIRST for b in (" ", "_", "-", "") for c in ("Key", "TOKEN", "secret", "Id")] + ["token", "Secret", "password", "PASSWD", "passphrase", "pwd", "credential", "Credentials", "bearer", "authorization"]
    assert all(re.search(S.KEYWORD, w, re.IGNORECASE) and S.sensitive(f"x {w} y") for w in words) and not S.sensitive(None) and not S.sensitive("")


def test_equals_a_plain_loop(spark):
    rows, _ = planted()
    rows = rows + [(900 + k, t, "en", "s", None) for k, t in enumerate(ODD)]
    held = []
    for i, t, *_ in rows:
        for a, b in plain_candidates(t):
            held.append((i, a, t[max(0, a - 512) : a].replace(t[a:b], " "), t[a:b], t[b : b + 256].replace(t[a:b], " ")))
    seen = Counter(w for _, _, before, _, after in held for w in set(re.findall(r"(?<![a-z0-9])[a-z]{3,15}(?![a-z0-9])", f"{before} {after}".lower())))
    top = sorted((-n, w) for w, n in seen.items() if n >= 2)[:4096]
    primed = (S.IDENTIFIERS + " ".join(w for _, w in reversed(top))).encode()
    want = []
    for i, start, before, run, after in held:
        d = zstandard.ZstdCompressionDict(primed + (after + " " + before).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z = zstandard.ZstdCompressor(level=12, dict_data=d, write_content_size=False)
        n = len(z.compress((before[-96:] + run).encode())) - len(z.compress(before[-96:].encode()))
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", run):
            size = 16
        else:
            odd = [c for c in run if not (c.isascii() and c.isalnum())]
            size = 10 * any(c.isdigit() for c in run) + 26 * any(c.islower() for c in run) + 26 * any(c.isupper() for c in run) + (0 if not odd else 2 if all(c in "+/_-=" for c in odd) else 32)
        if n >= 7 and n >= len(run) * math.log2(max(size, 2)) / 8:
            want.append((i, start, len(run), n))
    assert rows_of(S.scan(table(spark, rows)), "doc_id", "start", "length", "added_bytes") == sorted(want, key=repr) and len(want) > 60


def test_secrets_stay_out_of_result_and_dictionary(spark):
    rows, _ = planted()
    runs = [c[3] for _, t, *_ in rows for c in S.candidates(t, 48, 512)]
    text = repr(S.scan(table(spark, rows)).collect())
    assert not [r for r in runs if r in text]

def test_awkward_rows(spark):
    line = 'token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0ffeeddcc"'
    rows = awkward() + [(50, line, None, None, None), (50, line, None, None, None), (None, line + "\n" + line, None, None, None), (51, LONG + line, None, None, None)]
    got = rows_of(S.scan(clashing(table(spark, rows))), "doc_id", "start", "length")
    assert {(50, 9, 40), (None, 9, 40), (51, len(LONG) + 9, 40)} <= set(got)
    assert got.count((50, 9, 40)) == 2
    assert S.scan(table(spark, [])).count() == 0
