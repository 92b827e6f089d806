"""Secret scans: patterns, and the novelty of strings to a dictionary-primed zstandard compressor.

A long string with a sensitive word in the text around it, on either side and across lines, is a candidate, and so is one
that follows a candidate closely, as the lines of a key block do. It is compressed together with the text around it by a
compressor that already knows common identifiers: those of code, and those that most documents of the corpus hold, which are
counted first. What the string adds to the compressed size, in bytes, tells how much of it neither the text around nor the
dictionary explains. Random keys add about as many bytes as they carry; names and words add few. Strings that the patterns
found are measured as well.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so this is [0-9a-f]+ of 24 or more
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make strings candidates whose surroundings, AROUND characters on both sides, hold one.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "private", "credential", "bearer", "auth", "access_key", "signature")
AROUND = 400
#: A candidate is reported if it adds so many bytes for each of its characters, and so many in all.
LEAST_SHARE, LEAST_BYTES = 0.7, 12
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")  # plain numbers are no candidates
_DIGITS = re.compile(r"[0-9]+")
#: Identifiers of the corpus: letters alone, as keys seldom are; so many of the most frequent ones make the dictionary.
_IDENTIFIER = re.compile(r"[A-Za-z_]{3,24}")
MAX_IDENTIFIERS = 4096
#: Counts of so many different ones are held in a task; then they are passed on.
HELD = 200_000

#: What the compressor knows from the start.
IDENTIFIERS = """
import from return class def function const let var public private protected static void string int long bool boolean float
double true false null none self this new delete try except catch finally raise throw if else elif for while do switch case
break continue in is not and or lambda yield async await with as export default module require include package namespace
interface implements extends override virtual struct enum union typedef template typename auto final abstract synchronized
print println printf format logger logging info debug warning error critical exception message status code response request
client server session connection database query table column index key value name type id user username password passwd
secret token api_key apikey access_key secret_key private_key public_key authorization bearer basic credential credentials
config configuration settings environment env path file filename directory folder read write open close append buffer stream
input output result data item items list array map dict set queue stack node tree graph parent child children root leaf
count size length width height offset limit start stop end begin first last next previous current total sum average min max
http https localhost example com org net www html json xml yaml csv text utf encoding decode encode base64 hash digest sha256
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
"""


@lru_cache(maxsize=1)
def _compressor(identifiers: str):
    import zstandard

    known = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=9)
    return zstandard.ZstdCompressor(level=9, dict_data=known, write_checksum=False, write_content_size=False)


def common_identifiers(docs: DataFrame, text_col: str = "text", most: int = MAX_IDENTIFIERS) -> str:
    """The identifiers that most documents of the whole corpus hold, the commonest last: there a compressor finds them best."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(_IDENTIFIER.findall(text or "")))
                if len(seen) > HELD:
                    yield rows()
                    seen.clear()
        yield rows()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counted.filter("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()
    return " ".join(r["word"] for r in reversed(best))


def marginal_bytes(text: str, start: int, stop: int, identifiers: str = IDENTIFIERS) -> int:
    """Bytes that the string adds to the compressed text around it."""
    before, own, after = text[max(0, start - AROUND) : start], text[start:stop], text[stop : stop + AROUND]
    size = lambda x: len(_compressor(identifiers).compress(x.encode("utf-8", "surrogatepass")))
    return size(after + before + own) - size(after + before)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start and kind."""
    low, out = text.lower(), []
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, identifiers: str = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """Incompressible strings amid sensitive words. The sensitive context goes on from a find to the strings within AROUND
    characters after it."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    out, reach = [], -1
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if _DIGITS.fullmatch(text, a, b):
            continue
        # the string's own characters are no context; lower-casing may change lengths, so it comes after the cut
        near = a <= reach or any(w in part for part in (text[max(0, a - AROUND) : a].lower(), text[b : b + AROUND].lower()) for w in SENSITIVE)
        if near and (n := marginal_bytes(text, a, b, identifiers)) >= LEAST_BYTES and n >= LEAST_SHARE * (b - a):
            out.append((a, 3, b))
            reach = b + AROUND
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: str | None = None) -> DataFrame:
    """For each row of ``docs``: its id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    ``identifiers``: what the compressor knows from the start; None: IDENTIFIERS and the common ones of ``docs``, counted first.

    ``spans`` lists kind:start:end of all finds by start, then kind; code points, end exclusive. A null or empty text has none.
    Rows that repeat are reported as often; rows without an id keep the null. An empty table gives an empty result. Other
    columns are ignored, whatever their names. Only counts of identifiers are shuffled: every text is scanned whole, by itself.
    """
    if identifiers is None:
        identifiers = f"{IDENTIFIERS} {common_identifiers(docs, text_col)}"
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                base, found = [], []
                for text in part.column(1).to_pylist():
                    base.append(base_spans(text or ""))
                    found.append(sorted(base[-1] + novel_spans(text or "", identifiers)))
                counts = [pa.array([sum(k == kind for _, k, _ in x) for x in found], pa.int64()) for kind in range(4)]
                hashes = [hashlib.sha256(written(x).encode()).hexdigest() for x in base]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(hashes, pa.string()), pa.array(map(written, found), pa.string())], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string").withColumnRenamed("id", id_col)
