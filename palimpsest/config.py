"""Settings of a store, and the cost model of decoding."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import InvalidArgument

KIB = 1024

#: Permanent codec numbers, as fixed values.
CODEC_IDS = {"raw": 0x01, "repeat": 0x02, "arith": 0x03, "lz4": 0x10, "zstd": 0x11, "affine": 0x20, "template": 0x30}

#: Estimated nanoseconds to decode n bytes: fixed + per_byte * n, as fixed values.
DECODE_COST = {
    "raw": (12.0, 0.021),
    "repeat": (25.0, 0.016),
    "arith": (25.0, 0.026),
    "lz4": (40.0, 0.26),
    "template": (30.0, 0.45),
    "zstd": (2000.0, 0.40),
    "affine": (10.0, 0.10),
}


@dataclass(frozen=True)
class CodecPolicy:
    """Which codecs the selector may use, and what a microsecond of decoding is worth in bytes."""

    recipes: bool = True
    lz4: bool = True
    zstd: bool = True
    zstd_level: int = 3
    dictionary: bool = True
    template: bool = True
    budget_ns: float | None = None
    bytes_per_us: float = 32.0


@dataclass(frozen=True)
class Config:
    mode: str = "adaptive"  # or "pure": every unit is an affine seed, nothing is shared
    block_size: int = 16 * KIB
    inline_max: int = 16 * KIB
    keep_history: bool = False
    verify_on_read: bool = True
    dedupe: bool = True
    max_key: int = 4096
    max_value: int = 4 * KIB**3
    policy: CodecPolicy = field(default_factory=CodecPolicy)

    def __post_init__(self) -> None:
        if self.mode not in ("adaptive", "pure"):
            raise InvalidArgument(f"mode: {self.mode}")
        if not 512 <= self.block_size <= KIB**2:
            raise InvalidArgument("block_size: 512 to 1 MiB")
        if not 0 <= self.inline_max <= self.block_size:
            raise InvalidArgument("inline_max: at most block_size")
        if not 1 <= self.max_key <= 65536:
            raise InvalidArgument("max_key: 1 to 65536")

    @property
    def shares(self) -> bool:
        return self.dedupe and self.mode == "adaptive"
