"""Pooled descriptors of whole windows: one array in, all slots out, no row per sample, frame or bin.

The functions take windows as a matrix (windows x samples) and share one spectrum per kind of frame ends.
Definitions are those of ``descriptors``, which states them as joins and aggregates.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from pairloom.operators import descriptors as d

#: complex values of the spectra that are held at once
TOGETHER = 2_000_000
DIGITS = 9
#: pitches in Hz between which the period of a voice is looked for; weakest periodicity that counts
PITCH_LOW, PITCH_HIGH, VOICED = 75.0, 600.0, 1e-3
SIZES = {
    "cepstrum": 120, "mel": 256, "chroma": 24, "contrast": 14, "tonal": 12, "zcr": 2, "rms": 2,
    "phase": 7, "hnr": 1, "no_hnr": 1, "flatness": 2, "rolloff": 1, "novelty": 1, "fourier": 10,
}


def pooled(frames: np.ndarray) -> np.ndarray:
    """(windows x frames x bands) to all means, then all deviations."""
    return np.concatenate([frames.mean(1), frames.std(1)], 1)


def _matrix(rows: list[tuple[int, int, float]], bins: int, bands: int) -> np.ndarray:
    out = np.zeros((bins, bands))
    for k, band, weight in rows:
        out[k, band] += weight
    return out


def _wrap(x: np.ndarray) -> np.ndarray:
    return x - 2 * np.pi * np.floor((x + np.pi) / (2 * np.pi))


def _decibel(x: np.ndarray) -> np.ndarray:
    return 10 * np.log10(np.maximum(x, d.TINY))


class WindowBatch:
    """Equally long windows; every named part is (windows x slots). ``spectra`` are those by kind of ends, where they are known."""

    def __init__(
        self, samples: np.ndarray, n: int, hop: int, sr: int, shared: dict | None = None, spectra: dict[str, np.ndarray] | None = None,
    ) -> None:
        self.x, self.n, self.hop, self.sr, self.spectra = samples, n, hop, sr, spectra or {}
        self.bins, self.count = n // 2 + 1, samples.shape[1] // hop + 1
        self.shared = {} if shared is None else shared  # matrices, made once per task

    def _made(self, name: str, rule) -> np.ndarray:
        if name not in self.shared:
            self.shared[name] = rule()
        return self.shared[name]

    def frames(self, ends: str) -> np.ndarray:
        """Frames centred on multiples of the hop; ``ends`` says what lies beyond a window's ends."""
        x = np.pad(self.x, ((0, 0), (self.n // 2, self.n // 2)), mode=ends)
        return np.lib.stride_tricks.sliding_window_view(x, self.n, axis=1)[:, : self.x.shape[1] + 1 : self.hop]

    def _spectrum(self, ends: str) -> np.ndarray:
        if ends in self.spectra:
            return self.spectra[ends]
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(self.n) / self.n)
        return np.round(np.fft.rfft(self.frames(ends) * hann, axis=2), DIGITS) + 0.0

    @cached_property
    def spectrum(self) -> np.ndarray:
        return self._spectrum("constant")

    @cached_property
    def power(self) -> np.ndarray:
        return self.spectrum.real**2 + self.spectrum.imag**2

    @cached_property
    def size(self) -> np.ndarray:
        return np.sqrt(self.power)

    @cached_property
    def mel_frames(self) -> np.ndarray:
        """Band power in dB over reflecting ends, at most ``TOP_DB`` below the window's loudest."""
        spectrum = self._spectrum("reflect")
        weights = self._made("mel", lambda: _matrix(d.mel_table(self.n, self.sr), self.bins, d.N_MELS))
        level = _decibel((spectrum.real**2 + spectrum.imag**2) @ weights)
        return np.maximum(level, level.max((1, 2), keepdims=True) - d.TOP_DB)

    @cached_property
    def chroma_frames(self) -> np.ndarray:
        weights = self._made("pitch", lambda: _matrix(d.pitch_table(self.n, self.sr), self.bins, d.N_PITCH))
        summed = self.power @ weights
        top = summed.max(2, keepdims=True)
        return np.divide(summed, top, out=np.zeros_like(summed), where=top > 0)

    def cepstrum(self) -> np.ndarray:
        def cosines() -> np.ndarray:
            band, coef = np.meshgrid(np.arange(d.N_MELS), np.arange(d.N_CEPSTRA), indexing="ij")
            out = np.cos(np.pi / d.N_MELS * (band + 0.5) * coef) * np.sqrt(2.0 / d.N_MELS)
            out[:, 0] *= np.sqrt(0.5)
            return out

        c, half = self.mel_frames @ self._made("cosines", cosines), d.DELTA_HALF
        parts, offsets = [c], np.arange(-half, half + 1)
        squares = offsets**2 - (offsets**2).mean()
        for weights in (offsets / (offsets**2).sum(), 2 * squares / (squares**2).sum()):
            if self.count < 2 * half + 1:
                parts.append(np.zeros_like(c))
                continue
            inner = sum(w * c[:, half + j : self.count - half + j] for j, w in zip(offsets, weights))
            parts.append(inner[:, np.clip(np.arange(self.count) - half, 0, self.count - 1 - 2 * half)])
        return np.concatenate([pooled(p) for p in parts], 1)

    def mel(self) -> np.ndarray:
        return pooled(self.mel_frames)

    def chroma(self) -> np.ndarray:
        return pooled(self.chroma_frames)

    def contrast(self) -> np.ndarray:
        high, low = [], []
        table = d.contrast_table(self.n, self.sr)
        for band in range(d.CONTRAST_BANDS + 1):
            members = [row for row in table if row[1] == band]
            if not members:
                continue
            k = members[0][3]
            ordered = np.sort(self.size[:, :, [row[0] for row in members]], axis=2)
            high.append(_decibel(ordered[:, :, -k:].mean(2)))
            low.append(_decibel(ordered[:, :, :k].mean(2)))
        high, low = np.stack(high, 2), np.stack(low, 2)
        floor = lambda v: np.maximum(v, v.max((1, 2), keepdims=True) - d.TOP_DB)
        return pooled(floor(high) - floor(low))

    def tonal(self) -> np.ndarray:
        axes = self._made("tonal", lambda: _matrix(d.tonal_table(), d.N_PITCH, 6))
        total = np.abs(self.chroma_frames).sum(2, keepdims=True)
        sums = self.chroma_frames @ axes
        return pooled(np.divide(sums, total, out=np.zeros_like(sums), where=total > 0))

    def zcr(self) -> np.ndarray:
        below = np.pad(self.x < 0, ((0, 0), (self.n // 2, self.n // 2)), mode="edge")
        changes = np.cumsum(np.pad(below[:, 1:] != below[:, :-1], ((0, 0), (1, 0))), axis=1)
        first = np.arange(self.count) * self.hop
        return pooled(((changes[:, first + self.n - 1] - changes[:, first]) / self.n)[:, :, None])

    def rms(self) -> np.ndarray:
        energy = np.cumsum(np.pad(self.x**2, ((0, 0), (self.n // 2 + 1, self.n // 2))), axis=1)
        first = np.arange(self.count) * self.hop
        return pooled(np.sqrt(np.maximum(energy[:, first + self.n] - energy[:, first], 0) / self.n)[:, :, None])

    def phase(self) -> np.ndarray:
        if self.count < 3:
            return np.zeros((len(self.x), 7))
        angle = np.arctan2(self.spectrum.imag, self.spectrum.real)
        step = _wrap(np.diff(angle, axis=1))
        turn = np.abs(_wrap(np.abs(np.diff(step, axis=1)))).mean((1, 2))
        delay = _wrap(-np.diff(angle, axis=2)).std(2)
        spread, steady = angle.std(1), step.std(1)
        return np.stack([turn, *(f(v, 1) for v in (spread, steady, delay) for f in (np.mean, np.std))], 1)

    def hnr(self) -> np.ndarray:
        """Harmonics-to-noise in dB: mean over voiced frames, 0 without any.

        A frame's autocorrelation over that of its weights (both by transforms) has its highest value r in the lag
        range of a voice where the periodic part repeats; the ratio is r to 1 - r.
        """
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(self.n) / self.n)
        low, high = max(2, int(self.sr / PITCH_HIGH)), min(int(self.sr / PITCH_LOW), self.n // 2)
        if high < low:
            return np.zeros((len(self.x), 1))
        frames = self.frames("constant")
        # correlation of every frame with itself at all lags, zeros beyond its ends
        of = lambda v: np.fft.irfft(np.abs(np.fft.rfft(v, 2 * self.n)) ** 2)[..., : high + 1]
        own, weights = of((frames - frames.mean(2, keepdims=True)) * hann), of(hann)
        heard = own[..., :1] > d.TINY
        ratio = np.divide(own, own[..., :1], out=np.zeros_like(own), where=heard) / (weights / weights[0])
        r = np.clip(np.round(ratio[..., low:].max(2), DIGITS), 0, 1 - 1e-6)
        voiced = heard[..., 0] & (r > VOICED)
        level = np.where(voiced, 10 * np.log10(np.where(voiced, r / (1 - r), 1)), 0)
        return (level.sum(1) / np.maximum(voiced.sum(1), 1))[:, None]

    def no_hnr(self) -> np.ndarray:
        """The slot of the fast mode."""
        return np.zeros((len(self.x), 1))

    def flatness(self) -> np.ndarray:
        p = np.maximum(self.power, d.TINY)
        return pooled((np.exp(np.log(p).mean(2)) / p.mean(2))[:, :, None])

    def rolloff(self) -> np.ndarray:
        summed = np.cumsum(self.size, axis=2)
        a, b = ((summed >= share * summed[:, :, -1:]).argmax(2).mean(1) for share in (0.85, 0.95))
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)[:, None]

    def novelty(self) -> np.ndarray:
        k = min(8, self.count // 2)
        if self.count < 4 or k < 2:
            return np.zeros((len(self.x), 1))
        sums = np.cumsum(np.pad(self.chroma_frames, ((0, 0), (k + 1, k), (0, 0))), axis=1)
        at = np.arange(self.count) + k
        ahead, behind = sums[:, at + k] - sums[:, at], sums[:, at] - sums[:, at - k]
        return ((ahead - behind) ** 2).sum(2).mean(1)[:, None]

    def fourier(self) -> np.ndarray:
        m = self.bins // 2 + 1
        if self.count < 2 or m < 10:
            return np.zeros((len(self.x), 10))
        return np.stack([_artifacts(a, m) for a in np.abs(np.fft.rfft(self.size, axis=2)).mean(1)])

    def slots(self, parts: tuple[str, ...]) -> np.ndarray:
        return np.concatenate([getattr(self, part)() for part in parts], 1)


def _artifacts(a: np.ndarray, m: int) -> np.ndarray:
    """Ten numbers of one averaged second spectrum."""
    tail = a[1:]
    background = max(float(np.median(tail)), d.TINY)
    out, places = [], []
    for ratio in d.RATIOS:
        target, reach = m // ratio, max(1, m // (ratio * 10))
        region = a[max(1, target - reach) : min(m - 1, target + reach) + 1]
        out += [region.max() / background / 20, (region > 3 * background).sum() / 10]
        places += range(max(1, target - 1), min(m, target + 2))
    gaps = np.diff(np.flatnonzero(tail > 2.5 * background))
    regularity = 1 / (1 + gaps.std() / (gaps.mean() + 1e-8)) if len(gaps) > 1 else 0.0
    x = tail - tail.mean()
    best = 0.0
    if x.std() > d.TINY:
        lagged = np.correlate(x, x, "full")[len(x) - 1 :]
        lagged = lagged / (lagged[0] + d.TINY)
        peaks = lagged[1:-1][(lagged[1:-1] > lagged[:-2]) & (lagged[1:-1] > lagged[2:])]
        best = peaks.max() if len(peaks) else 0.0
    share = (a[places] ** 2).sum() / ((tail**2).sum() + d.TINY)
    return np.clip([*out, regularity, tail.max() / background / 30, best, share], 0, 1)


def window_slots(
    samples: np.ndarray, n: int, hop: int, sr: int, parts: tuple[str, ...], shared: dict, spectra: dict[str, np.ndarray] | None = None,
) -> np.ndarray:
    """(windows x slots) of all ``parts`` in their order, in portions of a bounded spectrum."""
    portion = max(1, TOGETHER // ((samples.shape[1] // hop + 1) * (n // 2 + 1)))
    known = lambda at: {ends: z[at] for ends, z in (spectra or {}).items()}
    cuts = [slice(k, k + portion) for k in range(0, len(samples), portion)]
    return np.concatenate([WindowBatch(samples[at], n, hop, sr, shared, known(at)).slots(parts) for at in cuts])
