"""Which tables of a remote catalog are kept as snapshots."""

from __future__ import annotations

from dataclasses import dataclass

K_MAX = 2**32 - 1


class PolicyError(ValueError):
    """A policy that cannot be read; ``kind`` says why."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.detail = kind, detail


def _k(text: str) -> int:
    if not text.removeprefix("+").isascii() or not text.removeprefix("+").isdigit() or int(text) > K_MAX:
        raise PolicyError("InvalidKValue", text)
    return int(text)


@dataclass(frozen=True)
class CachePolicy:
    """all, smart (the default), topk with ``k``, or select with a comma-separated ``table_set``."""

    kind: str = "smart"
    k: int = 0
    table_set: str = ""

    def __str__(self) -> str:
        return {"topk": f"topk:k={self.k}", "select": f"select:table_set={self.table_set}"}.get(self.kind, self.kind)

    @classmethod
    def from_string(cls, text: str) -> CachePolicy:
        """Read the stored form; k=0 and an empty table set pass here and are refused by ``check``."""
        if text in ("all", "smart", ""):
            return cls(text or "smart")
        kind, colon, rest = text.partition(":")
        if not colon or kind not in ("topk", "select"):
            raise PolicyError("InvalidCachePolicy", kind if colon else text)
        name = "k=" if kind == "topk" else "table_set="
        if not rest.startswith(name):
            raise PolicyError("KValueNotFound" if kind == "topk" else "TableSetNotFound")
        value = rest.removeprefix(name)
        return cls("topk", k=_k(value)) if kind == "topk" else cls("select", table_set=value)

    @classmethod
    def from_properties(cls, properties: dict[str, str]) -> CachePolicy:
        """Read the properties of CREATE CATALOG: cache_policy, k, table_set."""
        kind = properties.get("cache_policy", "smart")
        if kind in ("all", "smart"):
            return cls(kind)
        if kind not in ("topk", "select"):
            raise PolicyError("InvalidCachePolicy", kind)
        needed = "k" if kind == "topk" else "table_set"
        if needed not in properties:
            raise PolicyError("KValueNotFound" if kind == "topk" else "TableSetNotFound")
        return (cls("topk", k=_k(properties["k"])) if kind == "topk" else cls("select", table_set=properties["table_set"])).check()

    def check(self) -> CachePolicy:
        """Refuse what no sync could follow."""
        if self.kind == "topk" and self.k == 0:
            raise PolicyError("InvalidKValue", "0 is not allowed.")
        if self.kind == "select" and not self.table_set:
            raise PolicyError("InvalidTableSetValue", "empty string is not allowed.")
        return self

    def selected(self) -> list[str]:
        """The tables of a select policy."""
        return self.table_set.split(",")
