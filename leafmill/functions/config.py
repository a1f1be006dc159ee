"""Stored settings: a profile and per-preset profiles, as JSON files of the driver.

A missing or blank file gives defaults, a damaged one an error; older versions are migrated.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
from collections.abc import Mapping
from typing import Any

from leafmill.functions.presets import CONFIG_VERSION, FIELDS, PRESETS
from leafmill.sources.pdf_model import PdfError


def default_profile_path(env: Mapping[str, str] | None = None, system: str | None = None) -> str:
    """Where the profile is by default: below the system's folder of configurations."""
    env, system = os.environ if env is None else env, system or sys.platform
    if system.startswith("win"):
        base = env.get("APPDATA")
    elif system == "darwin":
        base = os.path.join(env["HOME"], "Library", "Application Support") if env.get("HOME") else None
    else:
        base = env.get("XDG_CONFIG_HOME") or (os.path.join(env["HOME"], ".config") if env.get("HOME") else None)
    if not base:
        raise PdfError("config", "there is no folder of configurations")
    return os.path.join(base, "leafmill", "profile.json")


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read().strip() or None
    except FileNotFoundError:
        return None
    except (OSError, UnicodeDecodeError) as e:
        raise PdfError("config", str(e)) from e


def _parsed(path: str) -> dict | None:
    text = _text(path)
    if text is None:
        return None
    try:
        found = json.loads(text)
    except ValueError as e:
        raise PdfError("config", str(e)) from e
    if not isinstance(found, dict):
        raise PdfError("config", "not an object")
    return found


def version_of(found: dict) -> int:
    """A file without a version counts as current."""
    v = found.get("version", CONFIG_VERSION)
    return v if isinstance(v, int) else CONFIG_VERSION


def migrated(profile: dict[str, Any], version: int) -> dict[str, Any]:
    """A profile of an older version: values that only were defaults then are dropped."""
    out = {k: profile.get(k) for k in FIELDS}
    if version < 2 and out["cmyk_conversion"] is not True:
        out["cmyk_conversion"] = None
    if version < 3 and str(out["bilevel_codec"]).strip().lower() in ("jpeg", "jpg"):
        out["bilevel_codec"] = None
    return out


def read_profile(path: str) -> dict[str, Any]:
    """The profile at path, every field null if there is none."""
    found = _parsed(path)
    return dict.fromkeys(FIELDS) if found is None else migrated(found, version_of(found))


def read_presets(path: str) -> dict[str, dict[str, Any]]:
    """Profiles by preset; unknown presets are left out."""
    found = _parsed(path) or {}
    stored = found.get("presets", {})
    if not isinstance(stored, dict):
        raise PdfError("config", "presets")
    return {k: migrated(v, version_of(found)) for k, v in stored.items() if k in PRESETS and isinstance(v, dict)}


def _write(path: str, value: dict) -> None:
    """Write beside path and rename, so that the file is whole at any time."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def write_profile(path: str, profile: dict[str, Any]) -> None:
    _write(path, {"version": CONFIG_VERSION} | {k: v for k, v in profile.items() if k in FIELDS and v is not None})


def write_presets(path: str, profiles: dict[str, dict[str, Any]]) -> None:
    _write(path, {"version": CONFIG_VERSION, "presets": {k: {f: x for f, x in v.items() if f in FIELDS and x is not None} for k, v in profiles.items() if k in PRESETS}})


def clear_presets(path: str) -> None:
    """Delete the file; that it isn't there is fine."""
    try:
        os.remove(path)
    except FileNotFoundError:
        pass
