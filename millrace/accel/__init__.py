"""The acceleration layer: remote catalogs, snapshots under a cache policy, routing, statistics."""

from millrace.accel.engine import Engine
from millrace.accel.policy import CachePolicy, PolicyError

__all__ = ["CachePolicy", "Engine", "PolicyError"]
