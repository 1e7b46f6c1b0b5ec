"""Settings of the codec, with the two presets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CodecConfig:
    min_block: int = 256
    max_block: int = 65_536
    energy_threshold: float = 0.02
    flux_threshold: float = 0.05
    zcr_threshold: float = 0.2
    graph: bool = True
    similarity: float = 0.92
    lsh_tables: int = 8
    lsh_bits: int = 12
    wavelet_levels: int = 6
    harmonic: bool = True
    max_harmonics: int = 32
    bitplane: bool = True
    slice_len: int = 1 << 16  # symbols that one entropy coder takes; more of a context go to further slices

    def __post_init__(self):
        if not 0 < self.min_block <= self.max_block:
            raise ValueError("block sizes must be positive, the least no larger than the most")
        if not 0 <= self.max_harmonics <= 255 or not 0 <= self.wavelet_levels <= 255:
            raise ValueError("harmonics and levels must fit in a byte")

    @property
    def window(self) -> int:
        """Samples of an analysis window."""
        return max(64, self.min_block // 4)

    @classmethod
    def best(cls) -> CodecConfig:
        return cls()

    @classmethod
    def fast(cls) -> CodecConfig:
        return replace(cls(), min_block=1024, max_block=8192, energy_threshold=0.05, flux_threshold=0.1, graph=False, lsh_tables=4, lsh_bits=10, wavelet_levels=3, harmonic=False, max_harmonics=8, bitplane=False)
