"""Secret scan: fixed patterns, and strings that zstandard cannot explain from what surrounds them.

Base kinds are regular expressions (leftmost, non-overlapping per kind; a match
that is too short still takes its characters).  Besides, every run of 16 or more
token characters that follows a sensitive word closely on its line is measured:
the bytes by which it lengthens the zstandard frame of the text around it, with
a dictionary of identifiers primed.  Names, words and repeated values cost a
fraction of their length there; a run of at least two of small letters, capitals
and digits that costs ``NOVEL`` bytes a byte or more is reported as kind ``novel``
unless it overlaps a base span.  (Random base64, hexadecimal digits and capitals
with digits measure 0.88 to 1.7 in given texts, words and identifiers 0.5 in the middle.)

Offsets are code points, ends exclusive.  Null texts count as empty and give no
spans; every row is scanned on its own, repeated rows alike; whole texts are
scanned whatever their length; an empty table gives no rows.  Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import documents, task, text_or_empty

# The contract's patterns and least lengths.
KINDS = ["assign", "access", "hex", "novel"]
_KEYWORD = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"
ASSIGN = re.compile(_KEYWORD + "\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
LEAST_ASSIGNED = 6
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")      # 20 characters or more
HEX = re.compile("[0-9a-f]{24,}")

#: A sensitive word, not the beginning of a longer one.
SENSITIVE = re.compile("(?i:passw(?:or)?d|passphrase|pwd|secret|token|credential|auth|bearer|private|signature|session|cookie|salt|cert|key)(?![a-z])")
CANDIDATE = re.compile("[A-Za-z0-9+/_=~$%!^&*-]{16,}")
CLASSES = [re.compile(c) for c in ("[a-z]", "[A-Z]", "[0-9]")]
#: Code points between a sensitive word and a candidate on the same line.
REACH = 48
#: Code points of context on either side of a candidate.
AROUND = 400
#: Marginal bytes a byte from which a candidate counts as novel.
NOVEL = 0.85

#: Common identifier parts that prime the compressor.
IDENTIFIERS = ("public private protected static const final class struct interface function return import export default "
               "string number boolean integer float double object array list map value values key keys token tokens session user username "
               "password secret client server request response header headers authorization bearer credential credentials account "
               "config configuration environment variable endpoint connection database address path file filename directory "
               "identifier index count length size name type message error exception result status code data content "
               "access refresh public_key private_key api_key access_token client_id client_secret signature certificate "
               "https http www com org localhost example test true false null none self this new get set create update delete "
               "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 -----BEGIN END----- RSA KEY")

SPAN = "array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    options = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(compression_params=options, dict_data=primed)


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Bytes that ``candidate`` adds to the compressed text around it: the least
    over its own place, the end and the beginning, as one place alone also
    shows how the frame's tables happen to fall."""
    pack = _compressor().compress
    b, a, c = (x.encode("utf-8", "surrogatepass") for x in (before, after, candidate))
    head = IDENTIFIERS.encode() + b"\n"
    whole = len(pack(head + b + b"\n" + a))
    return min(len(pack(head + x)) for x in (b + c + a, b + b"\n" + a + c, c + b + b"\n" + a)) - whole


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs of token characters within reach behind a sensitive word on its line."""
    done = 0
    for word in SENSITIVE.finditer(text):
        at = max(done, word.end())
        line = text.find("\n", word.end(), word.end() + REACH)
        last = word.end() + REACH if line < 0 else line
        while at < last and (m := CANDIDATE.search(text, at, len(text) if line < 0 else line)) and m.start() < last:
            if sum(1 for kind in CLASSES if kind.search(m[0])) > 1:
                yield m.start(), m.end()
            done = at = m.end()


def novel_spans(text: str, taken: list[tuple[int, int, int]], novel: float = NOVEL) -> list[tuple[int, int, int, float]]:
    """Incompressible strings in sensitive context that no span of ``taken`` overlaps."""
    out = []
    starts = np.array([s for s, _, _ in taken], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([e for _, _, e in taken], dtype=np.int64)) if taken else starts
    for a, b in candidates(text):
        before = int(np.searchsorted(starts, b))        # spans that start before the candidate's end
        if before and reach[before - 1] > a:
            continue
        s = text[a:b]
        cost = marginal_bytes(s, text[max(0, a - AROUND):a], text[b:b + AROUND]) / len(s)
        if cost >= novel:
            out.append((a, 3, b, round(cost, 4)))
    return out


def spans_of(text: str, novel: float = NOVEL) -> list[dict]:
    base = base_spans(text)
    found = sorted([(*s, None) for s in base] + novel_spans(text, base, novel), key=lambda s: s[:3])
    return [{"kind": KINDS[k], "start": a, "end": b, "novelty": x} for a, k, b, x in found]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novel: float = NOVEL) -> DataFrame:
    """``id_col`` and ``spans`` (kind, start, end, marginal bytes a byte of kind ``novel``) of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    # Texts without any of these hold no span: found by Arrow a batch at a time.
    marks = [f"(?i){_KEYWORD}".replace("\\x20", " "), "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}"]
    inner = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            hit = pc.match_substring_regex(text, marks[0])
            for m in marks[1:]:
                hit = pc.or_(hit, pc.match_substring_regex(text, m))
            sensitive = pc.and_(pc.match_substring_regex(text, "[A-Za-z0-9+/_=~$%!^&*-]{16}"),
                                pc.match_substring_regex(text, SENSITIVE.pattern.replace("(?![a-z])", "")))
            found = [spans_of(t.as_py(), novel) if h else [] for t, h in zip(text, pc.or_(hit, sensitive).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, inner)], ["id", "spans"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", T.DataType.fromDDL(SPAN))])
    return rows.mapInArrow(task(run), schema).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", novel: float = NOVEL) -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by ``mask`` (overlapping spans by one)."""
    text = docs.schema[text_col].dataType

    def clean(s: str) -> str:
        parts, at = [], 0
        for x in spans_of(s, novel):
            if x["start"] >= at:
                parts += [s[at:x["start"]], mask]
            at = max(at, x["end"])
        return "".join(parts) + s[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text_col)
            new = pa.array([None if t is None else clean(t) for t in b.column(i).to_pylist()], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays([new if j == i else c for j, c in enumerate(b.columns)], schema=b.schema)

    if not isinstance(text, T.StringType):
        raise TypeError(f"{text_col} is not text")
    return docs.mapInArrow(task(run), docs.schema)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: base counts and digest, and all spans of every document."""
    found = secret_spans(documents(spark, sf_dir).select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("novel"))
