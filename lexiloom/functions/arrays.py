"""Numeric columns and array columns: signal levels, masks, schedules, activations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def cosine(x: Column, y: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def rms(x: Column) -> Column:
    return F.sqrt(F.try_divide(dot(x, x), F.size(x)))


def raise_level(x: Column, target: float) -> Column:
    """Scaled up to the target root mean square where it is below; never down."""
    level = rms(x)
    return F.transform(x, lambda v: F.when(level < target, v * F.try_divide(F.lit(target), level)).otherwise(v))


def restore_level(x: Column, level: Column, target: float) -> Column:
    """Clamped to [-1, 1], and scaled back where the level had been raised."""
    clamped = F.transform(x, lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)))
    return F.transform(clamped, lambda v: F.when(level < target, v * level / target).otherwise(v))


def to_int16(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(F.least(F.round(v * 32768), F.lit(32767.0)), F.lit(-32768.0)).cast("int"))


def from_int16(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double") / 32768)


def token_positions(frames: Column, tokens: Column) -> Column:
    """For each frame the token it falls to, evenly; frames left over fall to the place after the last token."""
    each = F.floor(frames / F.greatest(tokens, F.lit(1)))
    place = lambda f: F.when(each > 0, F.least(F.floor(f / F.greatest(each, F.lit(1))), tokens)).otherwise(tokens)
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), (frames - 1).cast("int")), lambda f: place(f).cast("int"))).otherwise(F.array().cast("array<int>"))


def pad_mask(length: Column, width: Column) -> Column:
    """True from ``length`` on."""
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), (width - 1).cast("int")), lambda p: p >= length)).otherwise(F.array().cast("array<boolean>"))


def padded(x: Column, width: Column, pad: Column) -> Column:
    """One pad at least, then up to ``width`` + 1."""
    return F.concat(x, F.array_repeat(pad, F.greatest(width - F.size(x), F.lit(0)).cast("int") + 1))


def pad_to_multiple(x: Column, k: int, pad: Column) -> Column:
    return F.concat(x, F.array_repeat(pad, ((k - F.size(x) % k) % k).cast("int")))


def time_steps(n: int, shift: float) -> Column:
    """n + 1 points of [0, 1]: s * t / (1 + (s - 1) * t)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: shift * (k / n) / (1 + (shift - 1) * (k / n)))


def eden_rate(base: float, batch: Column, epoch: Column, batches: float, epochs: float, warm: float, start: float = 0.5) -> Column:
    """Learning rate that falls with the fourth root of batches and epochs, after a linear warm-up."""
    fall = F.pow((batch * batch + batches**2) / batches**2, F.lit(-0.25)) * F.pow((epoch * epoch + epochs**2) / epochs**2, F.lit(-0.25))
    rise = F.when(batch >= warm, F.lit(1.0)).otherwise(start + (1 - start) * batch / warm)
    return base * fall * rise


def adjusted_batches(batch: Column, max_duration: float, world: int, reference: float) -> Column:
    return batch * (max_duration * world) / reference


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def swoosh(x: Column, shift: float, slope: float, offset: float) -> Column:
    """log(1 + exp(x - shift)) - slope * x - offset."""
    return log_add_exp(F.lit(0.0), x - shift) - slope * x - offset


def swoosh_l(x: Column) -> Column:
    return swoosh(x, 4.0, 0.08, 0.035)


def swoosh_r(x: Column) -> Column:
    return swoosh(x, 1.0, 0.08, 0.313261687)


def timestep_embedding(t: Column, dim: int, longest: float = 10000.0) -> Column:
    """Cosines, then sines, of t at geometrically falling frequencies."""
    half = dim // 2
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: t * F.exp(-F.log(F.lit(longest)) * k / half))
    return F.concat(F.transform(angles, F.cos), F.transform(angles, F.sin))


def down_sample(x: Column, weights: list[float]) -> Column:
    """Weighted sums of groups of len(weights); the last element fills the last group."""
    k = len(weights)
    full = pad_to_multiple(x, k, F.element_at(x, -1))
    groups = F.sequence(F.lit(0), (F.size(full) / k).cast("int") - 1)
    return F.when(F.size(x) == 0, x).otherwise(F.transform(groups, lambda g: sum((F.get(full, g * k + i) * w for i, w in enumerate(weights)), F.lit(0.0))))


def up_sample(x: Column, k: int) -> Column:
    return F.flatten(F.transform(x, lambda v: F.array_repeat(v, k)))


def mix_channels(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def one_after_another(a: Column, b: Column) -> Column:
    """Two channels as one array each: the first prompt with silence behind it, the second with silence before it."""
    silence = lambda x: F.array_repeat(F.lit(0.0), F.size(x))
    return F.array(F.concat(a, silence(b)), F.concat(silence(a), b))


def channel(x: Column, width: int, second: bool = False) -> Column:
    """One of two channels of ``width`` features that stand side by side."""
    return F.slice(x, width + 1 if second else 1, width)


def flow_targets(clean: Column, noise: Column, t: Column) -> tuple[Column, Column]:
    """(f * t + n * (1 - t), f - n)."""
    return F.zip_with(clean, noise, lambda f, n: f * t + n * (1 - t)), F.zip_with(clean, noise, lambda f, n: f - n)


def duration_by_ratio(prompt: Column, prompt_tokens: Column, tokens: Column, speed: float) -> Column:
    """Frames for a text at the prompt's frames per token."""
    return prompt + F.ceil(F.try_divide(prompt * tokens, prompt_tokens * speed))


def max_tokens(duration: Column, tokens: Column, speed: float, cap: float) -> Column:
    """How many tokens fit beside the prompt."""
    each = F.try_divide(duration, tokens * speed)
    return F.try_divide(cap - duration, each).cast("int")
