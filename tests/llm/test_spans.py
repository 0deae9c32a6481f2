import hashlib
import random
import re
import string

import pytest

from odd_rows import ROWS
from switchyard.llm import pii, secret_scan as S


def brute_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def brute_secrets(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PII_PARTS = ["1", "2", "0", "255", "256", ".", ".", "-", " ", "@", "a", "+", "(", ")", "4111111111111111", "a@b.co", "_", "é", "1.2.3.4"]
SECRET_PARTS = ["password", "PASSWD", "toKen", "secret", "api_key", "ApiKey", "'", '"', " ", ":", "=", "abc", "abcdef",
                "AKIA", "X9", "Z" * 16, "0f" * 12, "0", "f", "K", "toKen", "ſecret", "."]


@pytest.mark.parametrize("find, brute, parts, base", [
    (pii.find, brute_pii, PII_PARTS, 4), (S.find, brute_secrets, SECRET_PARTS, 3),
])
def test_base_spans_match_the_patterns(find, brute, parts, base):
    rng = random.Random(2)
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert sorted(s for s in find(text) if s[1] < base) == brute(text), text


@pytest.mark.parametrize("text", [
    "a" * 200000, "1" * 200000, "1." * 100000, "a@" * 100000, "+1(" * 60000, "1 " * 100000, "AB12" * 50000,
    "password" * 20000, "secret   " * 20000, "AKIA" * 50000, "a1B" * 60000, "call 555 1234567 " * 8000,
])
def test_hostile_texts_take_linear_time(text):
    pii.find(text)
    S.find(text)


def test_method_adds_confirmed_spans():
    kinds = lambda t: [pii.KINDS[k] for _, k, _ in pii.find(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 please") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33 please") == []
    assert kinds("her social security number is 123-45-6789") == ["ssn"]
    assert kinds("order 123-45-6789 of the social security office") == []
    assert kinds("part 123-45-6789") == []


@pytest.mark.parametrize("text, want", [
    ("IBAN DE89370400440532013000 BIC COBADEFFXXX", ["DE89370400440532013000"]),
    ("DE89370400440532013000 EUR 50", ["DE89370400440532013000"]),
    ("GB82 WEST 1234 5698 7654 32 2024 report", ["GB82 WEST 1234 5698 7654 32"]),
    ("DE89 3704 0044 0532 0130 00 GB82WEST12345698765432", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]),
    ("NO9386011117947 NO9386011117947 A", ["NO9386011117947"] * 2),
    ("REF AB12 GB82 WEST 1234 5698 7654 32, paid", ["GB82 WEST 1234 5698 7654 32"]),
    ("DE89370400440532013000EUR 50", []),
    ("DE89370400440532013001 EUR 50", []),
])
def test_accounts_end_where_the_number_ends(text, want):
    assert [text[a:b] for a, k, b in sorted(pii.find(text)) if k == pii.IBAN] == want


def test_account_scan_takes_linear_time():
    pii.find("AB12 " * 40000)
    pii.find("A B12C DE89 " * 20000)


def test_randomness_battery_tells_keys_from_words():
    rng = random.Random(2)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=k)) for k in (24, 32, 40, 64) * 25]
    words = ["_".join(rng.choices(["order", "invoice", "File", "Name", "v2", "2024", "page", "user"], k=5)) for _ in range(100)]
    words += ["-".join(rng.choices(["the", "data", "2023", "01", "blog", "post"], k=6)) for _ in range(100)]
    hit = lambda t: any(k == S.RANDOM for _, k, _ in S.find(f"see {t} there"))
    assert sum(map(hit, keys)) >= 97
    assert sum(map(hit, words)) <= 4


def test_discoveries_follow_the_weighted_step():
    assert S.discoveries([], []) == []
    assert S.discoveries([1e-9, 0.5, 2e-4], [30, 30, 30]) == [0, 2]
    assert S.discoveries([6e-4, 0.9], [20, 20]) == []
    assert S.discoveries([6e-4, 0.9], [60, 20]) == [0]  # longer candidates have more weight


@pytest.mark.parametrize("run, brute, kinds", [
    (pii.personal_data, brute_pii, pii.KINDS[:4]), (S.secrets, brute_secrets, S.KINDS[:3]),
])
def test_odd_rows_and_empty_table(odd, nothing, run, brute, kinds):
    found = run(odd, detail=True).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert len(found) == len(ROWS)
    for r in found:
        spans = brute(texts[r.doc_id])
        written = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert all(texts[r.doc_id][f.start : f.end] == f.value for f in r.found)
    assert run(nothing).count() == 0
