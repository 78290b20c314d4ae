"""Which named tables there are, what they were built from, and how to build a missing one.

Every table of a site has a rule: its input tables and a function that writes
it.  ``_manifest/<name>`` under the root notes the version a table was built at:
a digest of its inputs' versions, the source's version and the settings that
the rule reads.  :func:`ensure` builds a table that is not there, or whose
inputs have changed, after its inputs; a table that was lost and is built again
from the same inputs gets the version it had, so nothing that hangs on it is
built again.  Tables that are kept until they are asked for anew (stored
parameters and forecasts) do not follow their inputs' versions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loadcurve.sources import tables as TB


@dataclass(frozen=True)
class Rule:
    inputs: tuple[str, ...]
    build: Callable[[Site], None]
    settings: tuple[str, ...] = ()   # of Site.settings
    follows: bool = True


@dataclass
class Site:
    """Tables under one root, with the settings of its last refresh."""

    spark: SparkSession
    root: str
    rules: dict[str, Rule]
    by: list[str] = field(default_factory=list)
    raw: DataFrame | None = None         # the source; only needed where its direct products are built
    settings: dict = field(default_factory=dict)
    built: list[str] = field(default_factory=list)   # what this object has built, in order

    def read(self, name: str) -> DataFrame:
        return TB.read_table(self.spark, name, self.root)

    def write(self, df: DataFrame, name: str, partition_by=None) -> None:
        TB.write_table(df, name, self.root, partition_by)

    def note(self, name: str, value: dict) -> None:
        path = TB.table_path(self.root, f"_manifest/{name}")
        self.spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").write.mode(
            "overwrite").text(path)

    def noted(self, name: str) -> dict:
        path = TB.table_path(self.root, f"_manifest/{name}")
        if not TB.path_exists(self.spark, f"{path}/_SUCCESS"):
            return {}
        return json.loads(self.spark.read.text(path).filter("value <> ''").first()[0])

    def _version(self, name: str, inputs: dict[str, str]) -> str:
        rule = self.rules[name]
        said = [name, self.by, inputs, {s: str(self.settings.get(s)) for s in rule.settings}]
        return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()[:32]

    def ensure(self, name: str) -> str:
        """Build the table if it is missing or behind its inputs; gives its version."""
        if name == "source":
            return str(self.settings.get("source_version"))
        rule, there = self.rules[name], TB.path_exists(self.spark, f"{TB.table_path(self.root, name)}/_SUCCESS")
        noted = self.noted(name).get("version")
        if there and not rule.follows:
            return noted or ""
        want = self._version(name, {i: self.ensure(i) for i in rule.inputs})
        if there and noted == want:
            return want
        return self.rebuild(name, want)

    def rebuild(self, name: str, version: str | None = None) -> str:
        """Build the table from its inputs as they are, whatever it has now."""
        rule = self.rules[name]
        version = version or self._version(name, {i: self.ensure(i) for i in rule.inputs})
        if "source" in rule.inputs and self.raw is None:
            raise RuntimeError(f"table {name!r} is missing and no source was given to build it from")
        rule.build(self)
        self.note(name, {"version": version, "inputs": list(rule.inputs)})
        self.built.append(name)
        return version
