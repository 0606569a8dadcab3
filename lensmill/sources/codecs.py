"""JSON codecs of scan payloads, features and plugin outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short keys of a scanned media record.
SCAN_KEYS = {"filePath": "p", "fileName": "n", "mediaType": "t", "capturedAtMs": "c", "modifiedAtMs": "m", "fileSize": "s", "width": "w", "height": "h", "mimeType": "i", "durationMs": "d", "latitude": "la", "longitude": "lo", "make": "ma", "model": "mo"}
SCAN_SCHEMA = "p string, n string, t string, c long, m long, s long, w int, h int, i string, d long, la double, lo double, ma string, mo string"
FEATURE_SCHEMA = "vector array<float>, metadata map<string, string>"
#: Outputs of the plugin kinds, told apart by their ``type``.
OUTPUTS = {
    "classification": "label string, confidence float, scores map<string, float>",
    "feature": FEATURE_SCHEMA,
    "detection": "boxes array<struct<left: float, top: float, right: float, bottom: float, label: string, confidence: float>>",
    "image": "width int, height int, mime string",
}

#: Inputs of the plugin kinds.
INPUTS = {
    "image": "path string, width int, height int, pixels binary",
    "tensor": "values array<float>, shape array<int>",
    "multimodal": "path string, text string, metadata map<string, string>",
}


def encode_scan(columns: list[str]) -> Column:
    """A scan record of the given columns; nulls are left out."""
    return F.to_json(F.struct(*[F.col(c).alias(SCAN_KEYS[c]) for c in columns]))


def decode_scan(text: Column) -> Column:
    parsed = F.from_json(text, SCAN_SCHEMA)
    return F.struct(*[parsed[k].alias(c) for c, k in SCAN_KEYS.items()])


def decode_feature(text: Column) -> Column:
    return F.from_json(text, FEATURE_SCHEMA)


def decode_output(text: Column) -> Column:
    """The tagged union as a struct with one field for each kind; only the named kind is set."""
    kind = F.get_json_object(text, "$.type")
    return F.struct(kind.alias("type"), *[F.when(kind == name, F.from_json(text, shape)).alias(name) for name, shape in OUTPUTS.items()])
