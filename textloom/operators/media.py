"""Media: what the metadata of a picture says of its origin, and pictures without metadata. Containers are walked in Python
over Arrow batches; bytes that break off are read as far as they go. Unknown is null, never "made by people"."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys of text chunks that only generators write, and what in a prompt or another text shows one.
GENERATOR_KEYS = {"parameters", "workflow", "sd-metadata", "invokeai_metadata", "sui_image_params", "dream"}
PARAMETERS = re.compile(r"\bsteps:\s*\d+.*\b(?:sampler|cfg scale|seed):|\b(?:negative prompt|cfg scale):", re.I | re.S)
PROMPT = re.compile(r"class_type|ksampler|sampler", re.I)
TRAINED = ("trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia")
CAPTURED = "digitalCapture"
GENERATORS = ["Stable Diffusion", "ComfyUI", "InvokeAI", "Midjourney", "DALL-E", "Adobe Firefly", "Imagen", "NovelAI", "Flux"]
DROPPED = {"png": {b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME", b"caBX"}, "webp": {b"EXIF", b"XMP ", b"C2PA"}, "wav": {b"LIST", b"id3 ", b"ID3 ", b"bext", b"iXML", b"_PMX", b"C2PA"}}


def kind_of(data: bytes) -> str:
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png"
    if data.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    if data[:4] == b"RIFF" and data[8:12] in (b"WEBP", b"WAVE"):
        return {b"WEBP": "webp", b"WAVE": "wav"}[data[8:12]]
    return "other"


def parts_of(data: bytes, kind: str) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(name, body, start, end) of the chunks or segments of a file, as far as they are whole."""
    at = {"png": 8, "jpeg": 2}.get(kind, 12)
    while at + 8 <= len(data) or (kind == "jpeg" and at + 4 <= len(data)):
        if kind == "png":
            size, name = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
            body, end = at + 8, at + 12 + size
        elif kind == "jpeg":
            name = data[at : at + 2]
            if name[0] != 0xFF or name[1] in (0xDA, 0xD9):  # the picture itself follows
                return
            size = struct.unpack(">H", data[at + 2 : at + 4])[0] - 2
            body, end = at + 4, at + 4 + max(size, 0)
        else:
            name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            body, end = at + 8, at + 8 + size + size % 2
        if end > len(data):
            return
        yield name, data[body : body + max(size, 0)], at, end
        at = end


def texts_of(data: bytes, kind: str) -> list[tuple[str, str]]:
    """(key, text) of all metadata: text chunks by their keys, segments and other chunks as a whole."""
    out = []
    for name, body, _, _ in parts_of(data, kind):
        if kind == "png" and name in (b"tEXt", b"zTXt", b"iTXt"):
            key, _, rest = body.partition(b"\0")
            try:
                if name == b"zTXt":
                    rest = zlib.decompressobj().decompress(rest[1:], 1 << 22)
                elif name == b"iTXt":
                    packed, (_, _, rest) = rest[:1] == b"\1", (rest[2:].partition(b"\0")[0], 0, rest[2:].partition(b"\0")[2].partition(b"\0")[2])
                    rest = zlib.decompressobj().decompress(rest, 1 << 22) if packed else rest
            except zlib.error:
                continue
            out.append((key.decode("latin-1"), rest.decode("utf-8", "replace")))
        elif (kind == "png" and name in DROPPED["png"]) or (kind == "jpeg" and (0xE1 <= name[1] <= 0xEF or name[1] == 0xFE)) or (kind in ("webp", "wav") and name in DROPPED[kind]):
            out.append(("", body.decode("utf-8", "replace")))
    return out


def provenance(data: bytes | None) -> dict:
    """is_ai (true or null), provenance (ai, authentic or none), generator, confidence and signals of one file."""
    kind = kind_of(data or b"")
    signals, confidence, authentic = [], 0.0, False
    everything = ""
    for key, text in texts_of(data, kind) if kind != "other" else []:
        everything += f"\n{key}\n{text}"
        low = key.lower()
        if low in GENERATOR_KEYS or (low == "prompt" and PROMPT.search(text)) or (low and PARAMETERS.search(text)):
            signals.append(f"generation_params: {key}")
            confidence = max(confidence, 0.95)
        for mark in TRAINED:
            if mark in text:
                signals.append(f"source_type: {mark}")
                confidence = max(confidence, 0.97)
                break
        authentic = authentic or CAPTURED in text
    generator = next((g for g in GENERATORS if signals and g.lower() in everything.lower()), None)
    if generator:
        signals.append(f"generator: {generator}")
    return {"kind": kind, "is_ai": True if confidence else None, "provenance": "ai" if confidence else "authentic" if authentic else "none", "generator": generator, "confidence": confidence, "signals": signals}


def cleaned(data: bytes | None) -> tuple[bytes, int]:
    """The file without its metadata, and how many parts went. Other formats and broken files stay as they are."""
    data = data or b""
    kind, removed, kept, last = kind_of(data), 0, [], 0
    if kind == "other":
        return data, 0
    for name, body, start, end in parts_of(data, kind):
        drop = name in DROPPED.get(kind, ()) or (kind == "jpeg" and (name[1] in (0xE1, 0xED, 0xEB, 0xFE)))
        kept.append(data[last : start if drop else end])
        removed, last = removed + drop, end
    out = b"".join([*kept, data[last:]])
    if removed and kind in ("webp", "wav"):
        out = out[:4] + struct.pack("<I", len(out) - 8) + out[8:]
    return out, removed


def media_scan(files: DataFrame) -> DataFrame:
    """path and content -> path, kind, is_ai, provenance, generator, confidence, signals. Null content is an empty file."""

    def run(batches):
        for batch in batches:
            got = [provenance(x) for x in batch.column(1).to_pylist()]
            kinds = {"kind": pa.string(), "is_ai": pa.bool_(), "provenance": pa.string(), "generator": pa.string(), "confidence": pa.float64(), "signals": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[c] for g in got], t) for c, t in kinds.items())], names=["path", *kinds])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, is_ai boolean, provenance string, generator string, confidence double, signals array<string>")


def media_clean(files: DataFrame) -> DataFrame:
    """path and content -> path, content without metadata, removed."""

    def run(batches):
        for batch in batches:
            got = [cleaned(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int64())], names=["path", "content", "removed"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, removed long")
