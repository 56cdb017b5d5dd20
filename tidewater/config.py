"""Parameters of jobs: from a properties file, from arguments, from the session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def properties(text: str) -> dict[str, str]:
    """``key = value`` or ``key: value`` lines; # and ! begin comments, a final backslash joins lines."""
    out, held = {}, ""
    for line in text.splitlines():
        line = held + line.strip()
        held = ""
        if not line or line[0] in "#!":
            continue
        if line.endswith("\\"):
            held = line[:-1]
            continue
        at = min((k for k in (line.find("="), line.find(":")) if k >= 0), default=len(line))
        out[line[:at].strip()] = line[at + 1 :].strip()
    return out


def arguments(argv: list[str]) -> dict[str, str]:
    """``--key value`` and ``-key value``; a key without a value is ``true``. Negative numbers are values."""
    out, key = {}, None
    for a in argv:
        if a.startswith("-") and not a.lstrip("-")[:1].isdigit() and a.strip("-"):
            key = a.lstrip("-")
            out[key] = "true"
        elif key is None:
            raise ValueError(f"expected --key, found {a!r}")
        else:
            out[key], key = a, None
    return out


class Parameters(dict):
    """Parameters by name; later sources win."""

    @classmethod
    def of(cls, *sources: dict[str, str]) -> Parameters:
        out = cls()
        for s in sources:
            out.update(s)
        return out

    def required(self, key: str) -> str:
        if key not in self:
            raise KeyError(f"parameter {key} is missing")
        return self[key]

    def number(self, key: str, default: int | None = None) -> int:
        return int(self.required(key)) if default is None or key in self else default

    def flag(self, key: str, default: bool = False) -> bool:
        return str(self.get(key, default)).lower() in ("true", "1", "yes")

    def apply(self, spark: SparkSession, prefix: str = "spark.") -> None:
        """Sets the parameters that are settings of the session."""
        for k, v in self.items():
            if k.startswith(prefix) and spark.conf.isModifiable(k):
                spark.conf.set(k, v)
