"""The quality ratios judge clean text alike in any script, and see packed data that fills half of a document."""

import base64
import random

import pytest

from procspark.llm import quality_bands
from tests.llm.conftest import SF

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {"cyrillic": [0x430 + i for i in range(26)], "greek": [0x3B1 + i for i in range(25)] + [0x3AC], "three bytes": [0x4E00 + 37 * i for i in range(26)]}


@pytest.fixture(scope="module")
def prose(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet").filter("quality = 1"), "doc_id").collect()
    return [t for t in (r.text.lower() for r in rows) if t.isascii() and kept(t)]


def kept(text):
    return quality_bands._measure(text.encode(), quality_bands._Judge(quality_bands.Bands()))[6]


@pytest.mark.parametrize("script", SCRIPTS)
def test_clean_text_in_other_scripts_is_kept(prose, script):
    to = str.maketrans(dict(zip(LETTERS, map(chr, SCRIPTS[script]))))
    assert len(prose) > 50 and all(kept(t.translate(to)) for t in prose)
    assert not kept(" ".join(f"samesamesame{'ab'[b % 2] * (b // 2 + 1)}" for b in range(120)).translate(to))  # repetition still goes


def test_chinese_like_text_is_kept():
    rng = random.Random(4)
    weights = [1 / (k + 10) for k in range(2500)]
    signs = [chr(0x4E00 + 7 * k) for k in range(2500)]
    assert kept(" ".join("".join(rng.choices(signs, weights, k=rng.randint(2, 9))) for _ in range(600)))


def test_documents_half_of_base64_go(prose):
    for text in [t for t in prose if len(t) > 9000][:5] + [" ".join(prose[:40])]:
        packed = base64.b64encode(random.Random(len(text)).randbytes(len(text) * 3 // 4)).decode()
        assert not kept(f"{text}\n{packed}") and not kept(f"{packed}\n{text}")
