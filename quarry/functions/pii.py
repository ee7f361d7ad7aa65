"""Personal data: an ordered scrub with per-match tests, so it runs as an Arrow-batched function."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cpf_is_valid(digits: str) -> bool:
    """O-P2: eleven digits, not all alike, whose last two are the mod-11 check digits."""
    if not re.fullmatch(r"\d{11}", digits) or len(set(digits)) == 1:
        return False
    nums = list(map(int, digits))
    return all(sum(n * w for n, w in zip(nums, range(size + 1, 1, -1))) * 10 % 11 % 10 == nums[size] for size in (9, 10))


def plausible_phone(found: str) -> bool:
    """O-P3: 8 to 15 digits, not all alike."""
    digits = [c for c in found if c.isdigit()]
    return 8 <= len(digits) <= 15 and len(set(digits)) > 1


CONTEXT_CHARS = 40
# Words that make an ambiguous number a phone number.
CONTEXT = re.compile(r"(?:telefone|celular|whats|zap|fone|contato|contacto|ligar|n[úu]mero|tel|phone|call|mobile)", re.IGNORECASE)


def has_context(match: re.Match) -> bool:
    """O-P4."""
    return CONTEXT.search(match.string, max(0, match.start() - CONTEXT_CHARS), match.start()) is not None


# Kind, pattern, placeholder, applied in this order; then the test that a match must pass.
STEPS = [
    ("url", r"(?:https?|ftp)://[^\s/@]+(?::[^\s/@]*)?@\S+", "[URL]", None),
    ("email", r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", "[EMAIL]", None),
    ("cnpj", r"(?<!\d)\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}(?!\d)", "[CNPJ]", None),
    ("cpf", r"(?<!\d)\d{3}\.\d{3}\.\d{3}-\d{2}(?!\d)", "[CPF]", None),
    ("cpf", r"(?<![\d.\-])\d{11}(?![\d.\-])", "[CPF]", lambda m: cpf_is_valid(m[0])),
    ("phone", r"(?<![\w+])\+\d{1,3}[\s.\-]?\(?\d{1,4}\)?[\s.\-]?\d{3,5}[\s.\-]?\d{3,5}(?!\d)", "[TELEFONE]", lambda m: plausible_phone(m[0])),
    ("phone", r"(?<!\d)\(\d{2}\)\s?\d{4,5}[-\s]?\d{4}(?!\d)", "[TELEFONE]", lambda m: plausible_phone(m[0])),
    ("phone", r"(?<!\d)9\d{2}\s\d{3}\s\d{3}(?!\d)", "[TELEFONE]", lambda m: plausible_phone(m[0])),
    ("phone", r"(?<!\d)\d{2}\s?9?\d{4}-\d{4}(?!\d)", "[TELEFONE]", lambda m: plausible_phone(m[0]) and has_context(m)),
]
KINDS = ["url", "email", "cnpj", "cpf", "phone"]
_COMPILED = [(kind, re.compile(pattern), mark, test) for kind, pattern, mark, test in STEPS]


def scrub_text(text: str | None) -> tuple[str | None, dict[str, int]]:
    """O-P1 on one string: the clean text and the number of replacements of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    for kind, pattern, mark, test in _COMPILED if text else []:
        hits = [m.span() for m in pattern.finditer(text) if test is None or test(m)]
        if hits:
            counts[kind] += len(hits)
            ends = [0, *(e for _, e in hits)]
            text = "".join(text[a:b] + mark for a, (b, _) in zip(ends, hits)) + text[ends[-1] :]
    return text, counts


SCRUBBED = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(k, T.IntegerType()) for k in KINDS)])


@F.pandas_udf(SCRUBBED)
def scrub(text: pd.Series) -> pd.DataFrame:
    """O-P1: struct of the clean text and counts by kind."""
    done = [scrub_text(t) for t in text]
    return pd.DataFrame({"text": [t for t, _ in done], **{k: pd.array([c[k] for _, c in done], dtype="int32") for k in KINDS}})
