"""Dictionaries and templates: trained on a bounded sample, judged on values kept apart, installed if they pay."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import InvalidArgument, Unsupported
from ..functions.codecs import Selector, net_gain, split_samples, train_dictionary, train_template


@dataclass(frozen=True)
class Training:
    """``status``: installed, rejected (no gain) or failed (nothing could be trained)."""

    kind: str
    status: str
    samples: int
    validation: int
    without: int = 0
    with_: int = 0
    gain: int = 0
    param_id: int | None = None


def bodies(selector: Selector, samples: list[bytes]) -> int:
    return sum(len(selector.choose(s)[2]) for s in samples)


def train(store, kind: str, samples: list[bytes], size: int = 64 * 1024, uses: int = 10_000) -> Training:
    if kind not in ("zstd_dict", "template"):
        raise InvalidArgument(kind)
    if store.config.mode == "pure":
        raise Unsupported("pure mode has no parameters")
    learn, judge = split_samples(samples)
    raw = train_dictionary(learn, size) if kind == "zstd_dict" else train_template([s[:size] for s in learn])
    if raw is None:
        return Training(kind, "failed", len(learn), len(judge))
    now = store.selector()
    trial = Selector(now.policy, now.mode, now.dictionary, now.template)
    setattr(trial, "dictionary" if kind == "zstd_dict" else "template", (1, raw))
    without, with_ = bodies(now, judge), bodies(trial, judge)
    gain = net_gain(without, with_, len(judge), uses, len(raw))
    if gain <= 0:
        return Training(kind, "rejected", len(learn), len(judge), without, with_, gain)
    return Training(kind, "installed", len(learn), len(judge), without, with_, gain, store.install_param(kind, raw))


class AutoDictionary:
    """Collects the first ``target`` small values that are written, trains once, and says what came of it."""

    def __init__(self, store, target: int = 2000, largest: int = 16 * 1024) -> None:
        self.store, self.target, self.largest = store, target, largest
        self.samples: list[bytes] = []
        self.report: Training | None = None

    @property
    def status(self) -> str:
        return "collecting" if self.report is None else self.report.status

    def observe(self, value: bytes) -> None:
        if self.report is None and 0 < len(value) <= self.largest:
            self.samples.append(value)
            if len(self.samples) >= self.target:
                self.finish()

    def finish(self) -> Training:
        """Train on what there is; a dictionary that was installed by hand meanwhile supersedes this one."""
        if self.report is None:
            if self.store.selector().dictionary is not None:
                self.report = Training("zstd_dict", "superseded", 0, 0)
            else:
                self.report = train(self.store, "zstd_dict", self.samples)
            self.samples = []
        return self.report
