"""Where stores and repositories are, and the limits that hold for them."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass

_SIZE = re.compile(r"^\s*(\d+)\s*([KMGT]?B?)\s*$", re.I)


@dataclass(frozen=True)
class Spec:
    kind: str  # file, s3 or http
    location: str
    name: str | None = None

    def uri(self) -> str:
        """The location as Spark's readers take it."""
        return {"file": "file://", "s3": "s3a://"}.get(self.kind, "") + self.location


def byte_count(text: str) -> int:
    """Bytes of 100, 7B, 3 KB, 1G, ... (base 1024)."""
    m = _SIZE.match(text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) << 10 * " KMGT".index(m[2][:1].upper().replace("B", "") or " ")


def read_config(text: str, overrides: tuple[str, ...] = ()) -> dict[str, dict[str, str]]:
    """Sections of an INI text, names of keys with - as _, with overrides section.key=value on top."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string(text)
    sections = {s: {k.replace("-", "_"): v for k, v in parser.items(s)} for s in parser.sections()}
    for o in overrides:
        place, _, value = o.partition("=")
        section, _, key = place.rpartition(".")
        sections.setdefault(section, {})[key.replace("-", "_")] = value
    return sections


def parse(spec: str, config: dict[str, dict[str, str]] | None = None, section: str = "repository", store: bool = False) -> Spec:
    """A spec s3://bucket/prefix, file:///path, http(s)://..., for stores also /path, or a name that the configuration resolves."""
    if spec.startswith("s3://"):
        if not spec[5:].split("/")[0]:
            raise ValueError("no bucket")
        return Spec("s3", spec[5:].rstrip("/"))
    if spec.startswith("file://"):
        return Spec("file", spec[7:])
    if re.match("https?://", spec):
        if store:
            raise ValueError("a file store can't be read over http")
        return Spec("http", spec)
    if store and spec.startswith("/"):
        return Spec("file", spec)
    own = (config or {}).get(f"{section}.{spec}")
    if own is None or "url" not in own:
        raise KeyError(f"no {section} is named {spec!r}")
    found = parse(own["url"], config, section, store)
    return Spec(found.kind, found.location, spec)


def limit(config: dict[str, dict[str, str]], key: str, *sections: str) -> int | None:
    """The limit from the first of sections that has its own: a number or size; none disables, inherit or nothing passes on."""
    for s in sections:
        value = config.get(s, {}).get(key, "inherit").strip().lower()
        if value == "none":
            return None
        if value != "inherit":
            return byte_count(value)
    return None
