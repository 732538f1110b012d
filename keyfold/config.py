"""Storage settings.  The numbers are targets of the on-disk layout, not of Spark."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StorageConfig:
    memtable_bytes: int = 64 << 20
    level_0_runs: int = 4
    level_1_bytes: int = 256 << 20
    level_growth: int = 10
    run_bytes: int = 64 << 20
    wal_segments: int = 16
    batch_window_ms: int = 10_000
    batch_commands: int = 50_000
    shards: int = 1

    def level_target(self, level: int) -> int:
        """Bytes that a level of 1 or more may hold."""
        return self.level_1_bytes * self.level_growth ** (level - 1)


#: Wire codes of a response.
ACK, VALUE, SHARD_MISMATCH, ERROR = 0, 1, 2, 3
