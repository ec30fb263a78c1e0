"""Axes of an artifact, their defaults, and the paths that they make."""

from __future__ import annotations

import re

# Defaults and values of the axes, the ends of file names, the folders of artifacts.
DEFAULTS = {"build": "O3S", "profile": "plain", "track": "direct", "scope": "rust-nonstd", "policy": "address"}
VALUES = {"profile": ("plain", "min"), "track": ("direct", "direct-in", "angr"), "scope": ("subject", "rust-nonstd"), "policy": ("address", "role")}
SUFFIXES = (".fixture.bin", ".gt.bin", ".fixture.json", ".gt.json", ".users.json", ".bin", ".json", ".rs")


FOLDERS = {
    "raw": ("extractions", "raw.json"), "gt": ("ground_truth", "gt.json"), "users": ("users", "users.json"), "boundaries": ("boundaries", "boundaries.json"), "manifest": ("build_info", "json"), "catalog": ("ground_truth/all-rust", "catalog.json"),
    "labels": ("extractions/oxidizer", "labels.json"), "audit": ("results/flirt", "audit.json"),
}
BUILD = r"(?i:O\d+[A-Z]*)"

_FILE = re.compile(rf"(?:.*/)?(?P<stem>(?P<case>[^/]*?)(?:\.(?P<build>{BUILD}))?)(?:{'|'.join(map(re.escape, SUFFIXES))})?/*", re.S)


def normalise(axis: str, value: str | None) -> str:
    """Default and case of an axis value; unknown values are refused."""
    text = value or DEFAULTS[axis]
    if axis == "build":
        return text.upper()
    if text.lower() in VALUES[axis]:
        return text.lower()
    raise ValueError(f"{axis} can't be {value!r}, only {' or '.join(VALUES[axis])}")


def split_case_build(name: str, build: str | None = None) -> tuple[str, str]:
    """Case and build of a file name such as ``case.O3S.fixture.json``; a given build leaves the whole stem as the case."""
    parts = _FILE.fullmatch(name)
    if parts is None:
        raise ValueError(f"no file name: {name!r}")
    named = parts["build"] if build is None else None
    return (parts["case"], named.upper()) if named else (parts["stem"], normalise("build", build))


def graph_path(case: str, build: str, profile: str = "plain", track: str = "direct", scope: str = "rust-nonstd", policy: str = "address") -> str:
    """Projected graph: track, policy and scope name a folder only where they aren't direct, address and subject."""
    axes = [(normalise("track", track), "direct"), (normalise("policy", policy), "address"), (normalise("scope", scope), "subject")]
    return "/".join(["fixtures", *[v for v, plain in axes if v != plain], normalise("profile", profile), f"{case}.{normalise('build', build)}.fixture.json"])


def artifact_path(kind: str, case: str, build: str, profile: str = "plain", scope: str = "rust-nonstd", inferred: bool = False) -> str:
    """Other artifacts, by the kinds of FOLDERS; ``inferred`` raw graphs have a folder of their own."""
    folder, end = FOLDERS[kind]
    scope = normalise("scope", scope)
    more = ["angr"] if kind == "raw" and inferred else [scope] if kind in ("gt", "users") and scope != "subject" else []
    return "/".join([folder, *more, normalise("profile", profile), f"{case}.{normalise('build', build)}.{end}"])


def result_path(case: str, name: str, profile: str = "plain") -> str:
    """A result file of a case; only the last part of either name counts."""
    parts = [text.rstrip("/").rpartition("/")[2] for text in (case, name)]
    for text, part in zip((case, name), parts):
        if part in ("", ".", ".."):
            raise ValueError(f"no name for a result: {text!r}")
    return "/".join(["results", parts[0], normalise("profile", profile), parts[1] if parts[1].endswith(".json") else parts[1] + ".json"])


def baseline_path(profile: str = "plain", every_mode: bool = False) -> str:
    return result_path("micro-corpus", "all_modes" if every_mode else "baseline", profile)
