"""The unread tail of a text under the bands, and texts made of the beginnings of secrets."""

import base64
import random
import time

import pytest

from procspark.llm import quality_bands, secret_scan


def prose(size, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    out = []
    while sum(map(len, out)) + len(out) < size:
        out.append(rng.choice(words))
    return " ".join(out)[:size].encode()


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("size", [8000, 8192, 8300])
def test_packed_data_at_the_end_is_read(seed, size):
    judge = quality_bands._Judge(quality_bands.Bands())
    clean = prose(size, seed)
    packed = base64.b64encode(random.Random(seed).randbytes(3072))
    assert judge.verdict(clean)[1] == 0.0
    _, outside, kept = judge.verdict(clean + packed)
    assert 0.25 < outside <= 0.5 and not kept


def test_a_short_packed_end_counts_for_its_own_bytes():
    judge = quality_bands._Judge(quality_bands.Bands())
    text = prose(4096 * 5, 1) + base64.b64encode(random.Random(1).randbytes(300))
    assert judge.verdict(text)[1] <= 400 / len(text) + 1e-9


PREFIXES = [b"eyJ", b"eyJa.", b"eyJ.eyJ", b"password", b"password ", b"token = ", b"AKIA", b"0a", b"ghp_", b"xoxb-", b"AIza", b"sk_live_", b"-----BEGIN ",
            b"-----BEGIN A", b"secret\"", b"api_key:"]


@pytest.mark.parametrize("prefix", PREFIXES, ids=lambda p: p.decode())
def test_a_megabyte_of_a_prefix_is_linear(prefix):
    text = prefix * (1_000_000 // len(prefix))
    start = time.time()
    for rule in secret_scan.RULES:
        secret_scan.matches(rule, text)
    assert time.time() - start < 20


def test_web_tokens_are_found_whole():
    rule = next(r for r in secret_scan.RULES if r.name == "jwt") if hasattr(secret_scan.RULES[0], "name") else secret_scan.RULES[7]
    token = b"eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dBjftJeZ4CVP-mB92K27uhbUJU1p1r"
    assert secret_scan.matches(rule, b"a " + token + b", b=" + token) == [(2, 2 + len(token)), (6 + len(token), 6 + 2 * len(token))]
    assert secret_scan.trigram_query(rule.pattern) != secret_scan.ALL
