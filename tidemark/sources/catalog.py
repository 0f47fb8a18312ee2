"""Sessions from ini files, typed parameters and load options."""

from __future__ import annotations

import configparser
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {"local_exp": "~/data", "network_exp": "", "user_sessions": "~/sessions", "memory_limit": "2e9", "floating_point": "double", "parallel": "true", "cache": "true", "loglevel": "info"}
#: Kinds of parameters; what isn't here is text.
KINDS = {"bandpass": "sequence", "notches": "sequence", "trigger_idx": "sequence", "car": "bool_or_num", "snip_transient": "bool_or_num", "resample_rate": "bool_or_num", "memory_limit": "bool_or_num", "units": "none_or_str", "exp_path": "path", "nwk_path": "path"}


def parse(text: str, kind: str = "text"):
    """A typed value: bool_or_num, sequence (whole numbers if all are), none_or_str, path, text."""
    clean = text.strip()
    if kind == "bool_or_num":
        low = clean.lower()
        if low in ("true", "yes", "on"):
            return True
        if low in ("false", "no", "off"):
            return False
        return float(clean)
    if kind == "sequence":
        parts = [x for x in re.split(r"[,\s]+", clean.strip("()[]")) if x]
        return tuple(int(x) if all(re.fullmatch(r"[+-]?\d+", y) for y in parts) else float(x) for x in parts)
    if kind == "none_or_str":
        return None if clean.lower() in ("none", "") else clean
    if kind == "path":
        return str(Path(clean).expanduser())
    return clean


@dataclass
class Config:
    """Global parameters: defaults, a file's values, then overrides."""

    values: dict[str, str] = field(default_factory=lambda: dict(DEFAULTS))

    @classmethod
    def load(cls, path: str | Path | None = None, **override: str) -> Config:
        out = cls()
        if path:
            p = configparser.ConfigParser(interpolation=None)
            p.read(path)
            for section in p.sections():
                out.values.update({k: v for k, v in p[section].items() if v})
        out.values.update(override)
        return out

    def get(self, key: str):
        return parse(self.values[key], KINDS.get(key, "text"))


def read_session(path: str | Path, config: Config | None = None) -> dict[str, dict]:
    """Recordings of a session file, typed: [session] and [DEFAULT] fill in what a recording doesn't say."""
    p = configparser.ConfigParser(defaults=(config or Config()).values)
    p.optionxform = str.lower
    p.read(path)
    shared = dict(p["session"]) if p.has_section("session") else {}
    own = {}
    for s in p.sections():
        if s != "session":
            keys = [k for k in {**shared, **dict(p[s])} if k not in DEFAULTS]
            own[s] = {k: parse(p[s][k] if k in p._sections[s] else shared.get(k, p[s].get(k, "")), KINDS.get(k, "text")) for k in keys}
    return own


def find_session(root: str | Path, name: str) -> Path:
    """``group/session`` below a root: the name with .txt or _conf.txt."""
    for tail in ("", ".txt", "_conf.txt"):
        at = Path(root).expanduser() / f"{name}{tail}"
        if at.is_file():
            return at
    raise FileNotFoundError(f"no session {name} below {root}")


def sessions(root: str | Path, group: str | None = None) -> list[str]:
    base = Path(root).expanduser()
    return sorted(str(p.relative_to(base).with_suffix("")).removesuffix("_conf") for p in base.glob(f"{group or '*'}/*.txt"))


def conf_table(spark: SparkSession, path: str | Path) -> DataFrame:
    """A session file as (section, key, value) rows."""
    p = configparser.ConfigParser(interpolation=None)
    p.read(path)
    rows = [(s, k.lower(), v) for s in p.sections() for k, v in p[s].items()]
    return spark.createDataFrame(rows, "section string, key string, value string")


def options(loader: Mapping, defaults: Mapping, session: Mapping, recording: Mapping, call: Mapping) -> dict:
    """Load options by precedence: later ones win where they say something."""
    out: dict = {}
    for level in (defaults, loader, session, recording, call):
        out.update({k: v for k, v in level.items() if v is not None})
    return out


def modern(args: Mapping) -> dict:
    """Old option names as new ones; unknown ones are dropped."""
    out = dict(args)
    if "useFs" in out:
        out["resample_rate"] = out.pop("useFs")
    if "downsamp" in out:
        d = out.pop("downsamp")
        out.setdefault("resample_rate", None if d in (None, 1) else ("ratio", d))
    known = {"resample_rate", "bandpass", "notches", "units", "car", "snip_transient", "trigger_idx", "load_channels", "causal_filtering"}
    return {k: v for k, v in out.items() if k in known}


def find_source(root: str | Path, recording: str, rate: float | None = None) -> tuple[Path | None, Path | None]:
    """(stored version at the wanted rate, raw source): a version made before is used rather than made again."""
    base = Path(root)
    stored = base / f"{recording}_Fs{int(rate)}" if rate else None
    raw = next((p for p in sorted(base.glob(f"*{recording}*")) if not stored or p != stored), None)
    return (stored if stored and stored.exists() else None), raw
