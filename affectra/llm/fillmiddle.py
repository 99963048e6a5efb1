"""Fill-in-middle transformation of whole texts, cut by tokens or code points.

Texts stay UTF-8 bytes. Where they part is found among bytes; an index of the
multibyte characters alone converts between code points and bytes, so ASCII
spans, which are most, cost arithmetic only. A task holds some megabytes of text
at a time and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, text_or_empty
from .substrings import slices

#: Marks of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Bytes of text cut at once.
CHUNK = 4 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class ExceptionIndex:
    """Code points and bytes of UTF-8: each multibyte character's position and the bytes that it has beyond one.

    Between recorded characters a code point is one byte, so a cut is converted
    by one search among them and one subtraction or addition.
    """

    def __init__(self, a: np.ndarray):
        self.at = np.flatnonzero(a >= 0xC0)
        lead = a[self.at]
        excess = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess, dtype=np.int64)])
        self.characters_at = self.at - self.before[:-1]

    def characters(self, cut: np.ndarray) -> np.ndarray:
        """Code points before byte cuts."""
        return cut - self.before[np.searchsorted(self.at, cut)]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before cuts in code points."""
        return cut + self.before[np.searchsorted(self.characters_at, cut)]


def token_starts(a: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Bytes at which tokens begin: runs of A-Z and a-z, and every other character; texts begin at `begins`."""
    letter, start = _LETTER[a], (a & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[begins] = True
    return np.flatnonzero(start)


def cuts(texts: list[bytes], h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Of each text: units, and the bytes and code points before its two cuts, which follow h1 and h2 modulo units + 1."""
    a = np.frombuffer(b"".join(texts), dtype=np.uint8)
    stop = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begin = stop - np.array([len(t) for t in texts], dtype=np.int64)
    index = ExceptionIndex(a)
    base = index.characters(begin)
    if unit == "token":
        starts = np.append(token_starts(a, begin[begin < stop]), len(a))
        first = np.searchsorted(starts[:-1], begin)
        n = np.searchsorted(starts[:-1], stop) - first
        place = lambda k: np.where(k < n, starts[np.minimum(first + k, len(starts) - 1)], stop)
    else:
        n = index.characters(stop) - base
        place = lambda k: index.bytes(base + k)
    x, y = h1 % (n + 1), h2 % (n + 1)
    lower, upper = place(np.minimum(x, y)), place(np.maximum(x, y))
    return n, lower - begin, upper - begin, index.characters(lower) - base, index.characters(upper) - base


def _unmistakable(markers: tuple[str, str, str]) -> None:
    """Refuses markers that could be found at a wrong place: none may hold another or begin as one ends."""
    for a in markers:
        for b in markers:
            if (a is not b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b) + 1))):
                raise ValueError(f"markers {a!r} and {b!r} can overlap")


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, unit: str = "token", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (its units), form, prefix_chars, middle_chars, output.

    The groups of eight digits of sha256("<seed>:<doc_id>") choose: the first two
    the cuts, modulo n + 1, the third whether the text stays plain (plain_percent
    in a hundred), the fourth the order (spm_percent: suffix first). unit is
    "token" (runs of English letters, and each other character) or "character".
    Empty and null texts, and texts that hold a marker, stay plain, without
    numbers of characters. A null id counts as an empty one; repeated rows are
    rows of their own with equal results; an empty table gives no rows; other
    columns aren't carried. restored() gives the text back.
    """
    if unit not in ("token", "character"):
        raise ValueError(f"unit {unit!r} is neither token nor character")
    _unmistakable(markers)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("key", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(column(id_col).cast("long").alias("d"), text_or_empty(column(text_col)).alias("t"), key.alias("key")).select("d", "t", *h)
    p, s, m = (x.encode() for x in markers)

    def run(batches):
        for b in batches:
            texts = b.column("t").cast(pa.binary()).to_pylist()
            h1, h2, h3, h4 = (b.column(f"h{i}").to_numpy() for i in range(1, 5))
            for i, j in slices([len(t) for t in texts], CHUNK):
                n, lower, upper, before, within = cuts(texts[i:j], h1[i:j], h2[i:j], unit)
                forms, out = [], []
                for t, x, y, order, dull in zip(texts[i:j], lower.tolist(), upper.tolist(), (h4[i:j] % 100 < spm_percent).tolist(), (h3[i:j] % 100 >= 100 - plain_percent).tolist(), strict=True):
                    if dull or not t or p in t or s in t or m in t:
                        forms.append("plain")
                        out.append(t)
                    elif order:
                        forms.append("spm")
                        out.append(s + t[y:] + p + t[:x] + m + t[x:y])
                    else:
                        forms.append("psm")
                        out.append(p + t[:x] + s + t[y:] + m + t[x:y])
                plain = np.array([f == "plain" for f in forms], dtype=bool)
                yield pa.RecordBatch.from_arrays([b.column("d").slice(i, j - i), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64(), mask=plain), pa.array(within - before, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_arrow(rows, run, SCHEMA)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text, from the output and its form alone: markers are found in order, and their parts put back."""
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        i = F.position(F.lit(second), output)
        j = F.position(F.lit(m), output, i)
        return F.substr(output, F.lit(len(first) + 1), i - len(first) - 1), F.substr(output, i + len(second), j - i - len(second)), F.substr(output, j + len(m))

    prefix, suffix, middle = parts(p, s)
    after, before, within = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, within, after)).otherwise(output)
