"""Providers of analysis: kinds of output, capability slots with a default, feature store.

A provider is Python code that the application registers; nothing is loaded from data.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import MISSING, asdict, dataclass, field
from dataclasses import fields as dataclass_fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmill.operators import merge
from lensmill.sources.codecs import OUTPUTS

CLASSIFICATION, FEATURE, DETECTION, IMAGE = "classification", "feature", "detection", "image"
#: Capability slots and the kind of output that each gives.
SLOTS = {"face": DETECTION, "scene": CLASSIFICATION, "semantic": FEATURE, "quality": CLASSIFICATION, "ocr": CLASSIFICATION}
STAGES = ("PRE", "MAIN", "POST")


class ManifestError(ValueError):
    """The JSON is no manifest or schema."""


#: Names of a manifest's fields in JSON.
FIELDS = {"plugin_id": "pluginId", "name": "name", "version": "version", "kind": "kind", "stage": "pipelineStage", "order": "order", "enabled": "enabled", "shape": "shape", "options": "options"}
DATA_TYPES = ("FLOAT", "INT", "STRING", "BOOLEAN", "FLOAT_ARRAY")


def parsed_object(text: str) -> dict:
    try:
        obj = json.loads(text)
    except ValueError as e:
        raise ManifestError(f"no JSON: {e}") from None
    if not isinstance(obj, dict):
        raise ManifestError("no JSON object")
    return obj


def parsed(text: str, cls: type) -> dict:
    """A dataclass's arguments from JSON, by FIELDS; fields that it does not know are passed over."""
    obj, out = parsed_object(text), {}
    kinds = {"str": str, "int": int, "bool": bool, "dict": dict}
    for f in dataclass_fields(cls):
        key = FIELDS[f.name]
        if key not in obj or obj[key] is None:
            if f.default is MISSING and f.default_factory is MISSING:
                raise ManifestError(f"{key} is missing")
        elif f.name == "shape":
            if not isinstance(obj[key], list) or any(not isinstance(x, int) for x in obj[key]):
                raise ManifestError(f"{key} is no list of whole numbers")
            out[f.name] = tuple(obj[key])
        elif not isinstance(obj[key], kinds[f.type]) or f.type == "int" and isinstance(obj[key], bool):
            raise ManifestError(f"{key} is of another type than {f.type}")
        else:
            out[f.name] = obj[key]
    return out


@dataclass
class Manifest:
    """What a plugin says of itself."""

    plugin_id: str
    name: str
    version: int
    kind: str
    stage: str = "MAIN"
    order: int = 0
    enabled: bool = True
    shape: tuple[int, ...] = ()
    options: dict = field(default_factory=dict)

    def problems(self) -> list[str]:
        """Why the manifest cannot be used; empty when it can."""
        out = []
        if not self.plugin_id.strip():
            out.append("pluginId must not be blank")
        if self.version < 1:
            out.append("version must be at least 1")
        if self.kind not in OUTPUTS:
            out.append(f"unknown kind {self.kind}")
        if self.stage not in STAGES:
            out.append(f"unknown stage {self.stage}")
        if any(d == 0 or d < -1 for d in self.shape):
            out.append("dimensions must be positive, or -1")
        return out


    def to_json(self) -> str:
        return json.dumps({FIELDS[k]: v for k, v in asdict(self).items()}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        """The manifest of a JSON object; what is missing without a default, or of another type, is named in the error."""
        return cls(**parsed(text, cls))


@dataclass
class FeatureSchema:
    """What a plugin's features hold: fields as (name, type, dimensions or null)."""

    plugin_id: str
    feature_type: str
    version: int = 1
    fields: tuple[tuple, ...] = ()

    def to_json(self) -> str:
        named = [{"name": n, "dataType": t} | ({"dims": list(d)} if d else {}) for n, t, d in self.fields]
        return json.dumps({"pluginId": self.plugin_id, "featureType": self.feature_type, "modelVersion": self.version, "fields": named}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> FeatureSchema:
        obj = parsed_object(text)
        for key in ("pluginId", "featureType"):
            if not isinstance(obj.get(key), str):
                raise ManifestError(f"{key} is missing")
        fields = []
        for f in obj.get("fields", []):
            if not isinstance(f.get("name"), str) or f.get("dataType") not in DATA_TYPES:
                raise ManifestError(f"unknown field {f}")
            fields.append((f["name"], f["dataType"], tuple(f["dims"]) if f.get("dims") else None))
        return cls(obj["pluginId"], obj["featureType"], int(obj.get("modelVersion", 1)), tuple(fields))


@dataclass
class Provider:
    """A manifest, a loader that runs once in each worker, and a function of a batch of inputs."""

    manifest: Manifest
    load: Callable[[], object]
    run: Callable[[object, pd.Series], pd.Series]
    ready: Callable[[], bool] = lambda: True

    def column(self, value: Column, returns: str) -> Column:
        """The provider as a scalar-iterator pandas function of a column."""
        load, run = self.load, self.run

        @F.pandas_udf(returns)
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield run(model, batch)

        return apply(value)


class Registry:
    """Providers by id, and the active one of each capability slot."""

    def __init__(self):
        self.providers: dict[str, Provider] = {}
        self.active: dict[str, str] = {}
        self.default: dict[str, str] = {}

    def register(self, provider: Provider, slot: str | None = None, default: bool = False) -> None:
        if problems := provider.manifest.problems():
            raise ValueError("; ".join(problems))
        if slot is not None and SLOTS.get(slot) != provider.manifest.kind:
            raise ValueError(f"slot {slot} takes no {provider.manifest.kind}")
        self.providers[provider.manifest.plugin_id] = provider
        if slot is not None and (default or slot not in self.default):
            self.default[slot] = provider.manifest.plugin_id

    def unregister(self, plugin_id: str) -> None:
        self.providers.pop(plugin_id, None)
        self.active = {s: p for s, p in self.active.items() if p != plugin_id}
        self.default = {s: p for s, p in self.default.items() if p != plugin_id}

    def activate(self, slot: str, plugin_id: str) -> None:
        if self.providers[plugin_id].manifest.kind != SLOTS[slot]:
            raise ValueError(f"slot {slot} takes no {self.providers[plugin_id].manifest.kind}")
        self.active[slot] = plugin_id

    def provider(self, slot: str) -> Provider | None:
        """The active provider while it is ready and enabled, else the default, else none."""
        for plugin_id in (self.active.get(slot), self.default.get(slot)):
            p = self.providers.get(plugin_id) if plugin_id else None
            if p is not None and p.manifest.enabled and p.ready():
                return p
        return None

    def of_kind(self, kind: str) -> list[Provider]:
        found = [p for p in self.providers.values() if p.manifest.kind == kind and p.manifest.enabled]
        return sorted(found, key=lambda p: (p.manifest.stage, p.manifest.order, p.manifest.plugin_id))


def store_features(existing: DataFrame, results: DataFrame, manifest: Manifest, data: Column) -> DataFrame:
    """The feature store with results of a plugin; a file's older ones of it are replaced."""
    new = results.select("filePath", F.lit(manifest.plugin_id).alias("pluginId"), F.lit(manifest.kind).alias("featureType"), F.to_json(data).alias("dataJson"), F.lit(OUTPUTS[manifest.kind]).alias("schemaJson"), F.lit(manifest.version).alias("modelVersion"))
    return merge.replace(existing, new, "filePath", "pluginId")


def prepared(pixels: Column, size: int, mean: float, std: float, bgr: bool = False) -> Column:
    """Interleaved 8-bit RGB samples of a size x size image as normalised numbers, channels swapped if asked."""
    @F.pandas_udf("array<float>")
    def prepare(rows: pd.Series) -> pd.Series:
        def one(raw):
            a = np.frombuffer(raw, np.uint8)[: size * size * 3].reshape(-1, 3).astype("f4")
            return (((a[:, ::-1] if bgr else a) - mean) / std).ravel()

        return rows.map(lambda raw: None if raw is None else one(raw))

    return prepare(pixels)
