"""Secret scans: complete secrets by pattern, and credentials whose parts only count together.

Three patterns give the base spans: a keyword with its value (``assign``), an access key (``access``) and a long
hexadecimal run (``hex``). The weak kinds are parts of a credential that say nothing alone: an account name
(``ident``), a random-looking string (``secret``), an address of a service (``endpoint``). Scopes are stretches of
``SCOPE`` code points around a part. Weak parts are joined by interval with their complements in their scope, and only
those with one are reported: a secret needs an identifier (or an access key), an identifier needs a secret (or an
assign or hex span), and an endpoint needs an identifier and a secret.

A scope never leaves its text, so the join is a merge of sorted starts within a row and nothing is shuffled.

Defined cases: null text counts as empty; an empty table gives an empty result; repeated rows each give their result;
spans are code points, end exclusive; other columns pass through, the added ones get the prefix ``secret_``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points on either side of a part in which its complement may stand.
SCOPE = 240
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
#: What replaces a secret; no base pattern matches it.
PLACEHOLDER = "[removed]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENT = re.compile(r"""(?<![A-Za-z0-9_])(?:user|user_?name|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
_ENDPOINT = re.compile(r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?""", re.I | re.A)
_RANDOM = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}", re.A)
#: One of these, in lower case, stands in every text with an assign span.
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    lower = text.lower()
    spans = []
    if any(k in lower for k in _KEYWORDS):
        spans += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    spans += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _random(run: str) -> bool:
    """Letters in both cases and digits, changing often, as written words don't."""
    kinds = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "-" for c in run]
    return {"0", "a", "A"} <= set(kinds) and sum(a != b for a, b in zip(kinds, kinds[1:])) * 3 >= len(run)


def _near(part: Span, starts: list[int], ends: list[int]) -> bool:
    """Whether a span with one of ``starts`` or ``ends`` (both sorted) lies wholly before or after ``part``, in its scope."""
    after, before = bisect_left(starts, part[1]), bisect_left(ends, part[0] - SCOPE)
    return (after < len(starts) and starts[after] <= part[1] + SCOPE) or (before < len(ends) and ends[before] <= part[0])


def _clear(span: Span, others: list[Span], ends: list[int]) -> bool:
    """Whether ``span`` overlaps none of ``others``, which are sorted and don't overlap each other."""
    at = bisect_left(ends, span[0] + 1)
    return at == len(others) or others[at][0] >= span[1]


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """The weak parts of ``text`` that have their complement in scope."""
    idents = [(*m.span(), "ident") for m in _IDENT.finditer(text)] if ":" in text or "=" in text else []
    access = [s for s in base if s[2] == "access"]
    if not idents and not access:
        return []  # every link has an identifier
    endpoints = [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)]
    held = [sorted(s for s in base if s[2] == kind) for kind in KINDS[:3]] + [idents, endpoints]
    held = [(spans, [s[1] for s in spans]) for spans in held]
    random = [(*m.span(), "secret") for m in _RANDOM.finditer(text) if _random(m[0])]
    secrets = [s for s in random if all(_clear(s, spans, ends) for spans, ends in held)]
    strong = [s for s in base if s[2] != "access"]
    names, values = [sorted(s[k] for s in idents + access) for k in (0, 1)], [sorted(s[k] for s in secrets + strong) for k in (0, 1)]
    out = [s for s in secrets if _near(s, *names)] + [s for s in idents if _near(s, *values)]
    return out + [s for s in endpoints if _near(s, *names) and _near(s, *values)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        every = sorted(base + linked_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))
        count = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
        rows.append((*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
    return pd.DataFrame(rows, columns=["assign", "access", "hex", "base_sha256", "spans"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secret_``: assign, access, hex (counts), base_sha256, spans."""
    found = F.pandas_udf(_scan, "assign long, access long, hex long, base_sha256 string, spans string")
    rows = docs.withColumn("__found", found(F.col(text)))
    return rows.withColumns({f"secret_{c}": F.col(f"__found.{c}") for c in ("assign", "access", "hex", "base_sha256", "spans")}).drop("__found")


def _redacted(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        base = base_spans(text) if text else []
        parts = sorted(base + linked_spans(text, base)) if text else []
        done, pieces = 0, []
        for start, end, kind in parts:
            if kind == "assign":  # the keyword stays, its value goes
                start = end - len(_ASSIGN.match(text, start)[2])
            if kind in ("ident", "endpoint") or end <= done:
                continue
            pieces += [text[done:max(start, done)], PLACEHOLDER]
            done = end
        out.append("".join([*pieces, text[done:]]) if pieces else text)
    return pd.Series(out, index=texts.index, dtype=object)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in ``text``, and ``n_chars`` (where there is one) counted again. No row goes."""
    clean = docs.withColumn(text, F.pandas_udf(_redacted, "string")(F.col(text)))
    return clean.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else clean
