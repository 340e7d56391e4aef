"""Secret scan by dictionary-primed zstandard novelty.

Two kinds of strings in a sensitive context are candidates, both of at least
two classes (digits, lower case, upper case after the first letter, symbols; in
one of under ``min_run`` characters, what joins words is no symbol):

* what is assigned to a sensitive word (``word = value``, ``"word": "value"``,
  ``word => value``): all up to the closing quotation mark, or to the next blank
  or delimiter, with its punctuation, from ``min_value`` characters on;
* runs of ``min_run`` or more key characters that begin within ``reach``
  characters after a sensitive word.

Of overlapping candidates the longest is measured.  Its novelty is the number
of bytes that it adds to zstandard's compression where it stands: the dictionary
is the identifiers, the text after and the text before it, and the frame is the
end of the text before it, which costs next to nothing, with and without the
candidate.  ``C(lead + candidate) - C(lead)``, both primed with the surroundings.
Words, names, placeholders and repetitions are found in the dictionary and add
little; random strings aren't and add all that their alphabet can carry (half a
byte a hexadecimal digit) and more.  Candidates are reported that add
``min_bytes`` or more and at least ``min_ratio`` of that capacity.

The dictionary is a fixed list of programming identifiers and the ``words``
most frequent lower-case words (of 3 to 15 letters, in two windows or more) of
the windows of all candidates, counted in a pass of their own.  No candidate is
ever written anywhere, neither into a checkpoint nor into the result, which has
its place, a masked form and a fingerprint.

Cases: null and empty texts hold nothing.  Every occurrence is reported, in
repeated rows too.  Null ids are carried as null.  An empty table gives an empty
result.  Texts are scanned whole; columns other than id and text aren't read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks, tidy

KEYWORD = r"(?:api|access|secret|private|auth|client|session|encryption|signing)[ _-]?(?:key|token|secret|id)|token|secret|passw(?:or)?d|passphrase|pwd|credentials?|bearer|authorization"
_KEYWORD = re.compile(KEYWORD, re.IGNORECASE | re.ASCII)
#: Every text with a sensitive word, in lower case, has one of the first, or one of the second and one of the third.
_ALONE, _FIRST, _SECOND = ("token", "secret", "passw", "passphrase", "pwd", "credential", "bearer", "authorization"), ("api", "access", "private", "auth", "client", "session", "encryption", "signing"), ("key", "id")
_ASSIGNED = re.compile(r"""[\w.-]{0,64}["'`\])}]{0,2}[ \t]*(?:=>|:=|==|[:=])[ \t]*(?:(?P<q>["'`])(?P<quoted>(?:(?!(?P=q))[^\s\\]|\\.)+)(?P=q)|(?P<bare>[^\s"'`,;<>(){}\[\]]+))""")
_SYMBOL = re.compile(r"[^A-Za-z0-9]")
IDENTIFIERS = (
    "function return const static public private class import from default export async await string number boolean object value index length result response request "
    "client server config settings options password passwd secret token access_key api_key apikey private_key authorization bearer credentials username user_name "
    "account database connection host port localhost example placeholder changeme your_api_key_here your_token_here your_secret_here insert_key_here xxxxxxxx test_token "
    "00000000 12345678 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 environment process.env os.environ get_secret secret_name secret_key_base "
    "https://www.example.com/index.html application/json content_type session_id request_id created_at updated_at description version package module "
)
RESULT = "doc_id long, start int, length int, keyword string, added_bytes int, novelty double, masked string, fingerprint string"


def _classes(run: str, min_run: int) -> int:
    body, symbols = run[1:], _SYMBOL.findall(run.rstrip("="))
    return any(c.isdigit() for c in run) + any(c.islower() for c in run) + any(c.isupper() for c in body) + any(len(run) >= min_run or c not in "-_./:" for c in symbols)


def capacity(run: str) -> float:
    """The bytes that a random string of this length and alphabet carries."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        size = 16
    else:
        symbols = set(_SYMBOL.findall(run))
        size = 10 * any(c.isdigit() for c in run) + 26 * any(c.islower() for c in run) + 26 * any(c.isupper() for c in run) + (2 if symbols <= set("+/_-=") else 32) * bool(symbols)
    return len(run) * math.log2(max(size, 2)) / 8


def sensitive(text: str | None) -> bool:
    """Whether a text may have a sensitive word: plain searches, which are much cheaper than the expression."""
    low = text.lower() if text else ""
    return any(x in low for x in _ALONE) or (any(x in low for x in _SECOND) and any(x in low for x in _FIRST))


def places(text: str, reach: int, min_run: int, min_value: int) -> list[tuple[int, int, str]]:
    """(start, end, sensitive word) of the candidates of a text, in order, none within another."""
    words, found, k, end = list(_KEYWORD.finditer(text)), [], 0, 0
    for word in words:
        m = _ASSIGNED.match(text, word.end()) if word.start() >= end else None  # a value's own words have no values
        if m:
            start, end = m.span("quoted" if m["quoted"] is not None else "bare")
            if end - start >= min_value:
                found.append((start, end, word.group().lower()))
    for run in re.finditer(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % min_run, text) if words else ():
        while k + 1 < len(words) and words[k + 1].end() <= run.start():
            k += 1
        if words[k].end() <= run.start() <= words[k].end() + reach:
            found.append((*run.span(), words[k].group().lower()))
    out: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0] - x[1], x[0])):  # the longest first
        at = bisect.bisect(out, x)
        if _classes(text[x[0] : x[1]], min_run) >= 2 and (not at or out[at - 1][1] <= x[0]) and (at == len(out) or x[1] <= out[at][0]):
            out.insert(at, x)
    return out


def candidates(text: str, reach: int, window: int, min_run: int = 16, min_value: int = 8) -> Iterator[tuple[int, str, str, str, str]]:
    """(start, keyword, before, run, after) of each candidate of a text; other copies of the run are cut out of what surrounds it."""
    for start, end, word in places(text, reach, min_run, min_value):
        run, before, after = text[start:end], text[max(0, start - window) : start], text[end : end + window // 2]
        # a secret that stands there twice is no more predictable for that
        yield start, word, before.replace(run, " "), run, after.replace(run, " ")


def added_bytes(primed: bytes, before: str, run: str, after: str, level: int = 12) -> int:
    """Bytes that the run adds to the compression of what leads to it, given its surroundings and the identifiers."""
    raw = lambda x: x.encode("utf-8", "replace")
    known = zstandard.ZstdCompressionDict(primed + raw(f"{after} {before}"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False)
    lead = raw(before[-96:])
    return len(compressor.compress(lead + raw(run))) - len(compressor.compress(lead))


_WORD = re.compile(r"(?<![a-z0-9])[a-z]{3,15}(?![a-z0-9])")


def dictionary(texts: DataFrame, words: int, reach: int, window: int, min_run: int, min_value: int) -> bytes:
    """Identifier dictionary, the most frequent words last, where zstandard reaches them most cheaply."""

    @tidy
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in chunks(batches, "t"):
            for t in filter(sensitive, batch.column("t").to_pylist()):
                for _, _, before, _, after in candidates(t, reach, window, min_run, min_value):
                    seen.update(set(_WORD.findall(f"{before} {after}".lower())))
            if len(seen) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()))], ["w", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    counted = texts.select("t").mapInArrow(near, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    top = counted.where("n >= 2").orderBy(F.col("n").desc(), "w").limit(words).collect()
    return (IDENTIFIERS + " ".join(r.w for r in reversed(top))).encode()


def scan(docs: DataFrame, reach: int = 48, window: int = 512, words: int = 4096, min_run: int = 16, min_value: int = 8, min_bytes: int = 7, min_ratio: float = 1.0, level: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``RESULT``: one row for each incompressible string in a sensitive context."""
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    primed = dictionary(texts, words, reach, window, min_run, min_value)

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            out = []
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                if not sensitive(t):
                    continue
                for start, keyword, before, run, after in candidates(t, reach, window, min_run, min_value):
                    n = added_bytes(primed, before, run, after, level)
                    novelty = n / capacity(run)
                    if n >= min_bytes and novelty >= min_ratio:
                        shown = min(2, len(run) // 8)
                        out.append((i, start, len(run), keyword, n, novelty, f"{run[:shown]}...{run[len(run) - shown :]}", hashlib.sha256(run.encode("utf-8", "replace")).hexdigest()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.string()]
            columns = list(zip(*out)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in RESULT.split(", ")])

    return texts.mapInArrow(measure, RESULT)
