"""Parsers of command words, lists and offset specifications. They run on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime


def split_command(line: str) -> list[str]:
    """Words of a command line: double quotes group, a backslash takes the next character as it is."""
    words, word, quoted, begun, chars = [], [], False, False, iter(line)
    for c in chars:
        if c == "\\":
            nxt = next(chars, None)
            if nxt is None:
                raise ValueError("unfinished escape")
            word.append(nxt)
            begun = True
        elif c == '"':
            quoted, begun = not quoted, True
        elif c.isspace() and not quoted:
            if begun:
                words.append("".join(word))
            word, begun = [], False
        else:
            word.append(c)
            begun = True
    if quoted:
        raise ValueError("unterminated quote")
    return [*words, "".join(word)] if begun else words


def comma_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def partition_list(text: str) -> list[int] | None:
    """Sorted ids without repeats; None (all) if none is given."""
    found = set()
    for x in comma_list(text):
        if not re.fullmatch(r"[+-]?\d+", x) or int(x) >= 1 << 31:
            raise ValueError(f"invalid partition {x!r}")
        if int(x) < 0:
            raise ValueError(f"partition must be non-negative, got {x}")
        found.add(int(x))
    return sorted(found) or None


# How specifications without a number are shown.
DESCRIBED = {"earliest": "earliest (beginning of partition)", "latest": "latest (end of partition / high watermark)"}


@dataclass(frozen=True)
class OffsetSpec:
    """mode: numeric, earliest, latest or timestamp; value: the offset, or milliseconds since 1970."""

    mode: str
    value: int | None = None

    def describe(self) -> str:
        if self.mode == "timestamp":
            return "timestamp:" + datetime.fromtimestamp(self.value / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        return f"{self.value} (numeric)" if self.mode == "numeric" else DESCRIBED[self.mode]


#: Fixed value: the layouts of instants; without a zone they are UTC.
INSTANT = re.compile(r"(\d{4}-\d\d-\d\d)(?:(T| )(\d\d:\d\d:\d\d)(\.\d+)?(Z|[+-]\d\d:\d\d)?)?")


def offset_spec(text: str) -> OffsetSpec:
    names = {"earliest": "earliest", "beginning": "earliest", "latest": "latest", "end": "latest"}
    if text.lower() in names:
        return OffsetSpec(names[text.lower()])
    if text.startswith("timestamp:"):
        m = INSTANT.fullmatch(text[10:])
        try:
            if not m or (m[2] == " " and (m[4] or m[5])):
                raise ValueError
            stamp = datetime.fromisoformat(m[1] + "T" + (m[3] or "00:00:00") + (m[5] or "+00:00").replace("Z", "+00:00"))
        except ValueError:
            raise ValueError(f"{text[10:]!r} is no instant: a date, or a date and time of ISO 8601") from None
        millis = int(((m[4] or ".0")[1:] + "000")[:3])
        return OffsetSpec("timestamp", int(stamp.timestamp()) * 1000 + millis)
    if not re.fullmatch(r"[+-]?\d+", text) or abs(int(text)) >= 1 << 63:
        raise ValueError(f"{text!r} is no offset: neither a number nor earliest, latest or timestamp:...")
    if int(text) < 0:
        raise ValueError(f"an offset of {text} is below zero")
    return OffsetSpec("numeric", int(text))


def prefix_limit(words: list[str], default: int = 100) -> tuple[str, int]:
    """``[prefix] [limit]``: one word that is a positive number is the limit."""
    if len(words) > 2:
        raise ValueError("at most a prefix and a limit")
    if len(words) == 1 and re.fullmatch(r"\+?\d+", words[0]):
        words = ["", words[0]]
    prefix, limit = (words + ["", str(default)][len(words) :])[:2] if words else ("", str(default))
    if not re.fullmatch(r"\+?\d+", limit) or int(limit) <= 0:
        raise ValueError("limit must be a positive integer")
    return prefix, int(limit)


# The protocols that a Kafka configuration may name.
PROTOCOLS = ("PLAINTEXT", "SSL", "SASL_PLAINTEXT", "SASL_SSL")


def kafka_options(text: str) -> dict[str, str]:
    """Options of Spark's Kafka source from a properties text (``key=value`` lines, ``#`` comments)."""
    found: dict[str, str] = {}
    for no, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, eq, value = line.partition("=")
        if not eq:
            raise ValueError(f"line {no}: expected key=value")
        found[key.strip()] = value.strip()
    if not found.get("bootstrap.servers"):
        raise ValueError("bootstrap.servers is required")
    protocol = found.setdefault("security.protocol", "PLAINTEXT").upper()
    if protocol not in PROTOCOLS:
        raise ValueError(f"unsupported security.protocol {protocol!r}")
    found["security.protocol"] = protocol
    if protocol.startswith("SASL"):
        user, password = found.pop("sasl.username", ""), found.pop("sasl.password", "")
        mechanism = found.setdefault("sasl.mechanism", found.pop("sasl.mechanisms", "PLAIN")).upper()
        module = {"PLAIN": "plain.PlainLoginModule", "SCRAM-SHA-256": "scram.ScramLoginModule", "SCRAM-SHA-512": "scram.ScramLoginModule"}.get(mechanism)
        if module is None:
            raise ValueError(f"unsupported sasl.mechanism {mechanism!r}")
        if not user or not password:
            raise ValueError("sasl.username and sasl.password are required")
        quoted = [x.replace("\\", "\\\\").replace('"', '\\"') for x in (user, password)]
        found["sasl.jaas.config"] = f'org.apache.kafka.common.security.{module} required username="{quoted[0]}" password="{quoted[1]}";'
    if "ssl.ca.location" in found:
        found |= {"ssl.truststore.type": "PEM", "ssl.truststore.location": found.pop("ssl.ca.location")}
    if found.pop("ssl.endpoint.identification.algorithm", "https").lower() in ("none", ""):
        found["ssl.endpoint.identification.algorithm"] = ""
    return {f"kafka.{k}": v for k, v in found.items()}
