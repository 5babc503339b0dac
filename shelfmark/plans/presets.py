"""Named settings of the duplicate finder and the classifier."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class DuplicateOptions:
    exact: bool = True
    perceptual: bool = False
    semantic: bool = False
    verified: bool = False
    phash_radius: int = 10
    dhash_radius: int = 12
    color_radius: int = 8
    frame_mean: float = 7.0
    verify_least: int = 6
    verify_most: int = 14
    sample_frames: int = 3
    same_dimensions: bool = False
    keep: str = "largest_pixels"

    def __post_init__(self):
        object.__setattr__(self, "phash_radius", max(0, min(64, self.phash_radius)))
        object.__setattr__(self, "dhash_radius", max(0, min(64, self.dhash_radius)))
        object.__setattr__(self, "sample_frames", max(1, min(24, self.sample_frames)))

    @property
    def needs_visual_hash(self) -> bool:
        return self.perceptual or self.semantic or self.verified

    @property
    def frame_radius(self) -> int:
        return int(max(self.phash_radius, self.frame_mean))


# The four presets.
DUPLICATE_PRESETS = {
    "fast": DuplicateOptions(phash_radius=8, dhash_radius=12, frame_mean=7, verify_least=6, verify_most=14, sample_frames=3),
    "balanced": DuplicateOptions(perceptual=True, phash_radius=10, dhash_radius=12, frame_mean=7, verify_least=6, verify_most=14, sample_frames=3),
    "strict": DuplicateOptions(perceptual=True, verified=True, phash_radius=8, dhash_radius=10, frame_mean=5, verify_least=6, verify_most=12, sample_frames=5),
    "deep": DuplicateOptions(perceptual=True, semantic=True, verified=True, phash_radius=12, dhash_radius=14, frame_mean=6, verify_least=6, verify_most=16, sample_frames=4),
}


def duplicate_options(preset: str = "balanced", **overrides) -> DuplicateOptions:
    """A preset with explicit settings on top; an unknown name is the balanced preset."""
    return replace(DUPLICATE_PRESETS.get(preset, DUPLICATE_PRESETS["balanced"]), **overrides)


@dataclass(frozen=True)
class ClassifyOptions:
    temperature: float = 0.07
    top_k: int = 5
    min_raw: float = 0.18
    threshold: float = 0.55
    min_margin: float = 0.12
    min_raw_margin: float = 0.02
    exemplar_boost: float = 1.38
    exemplar_min: float = 0.32
    exemplar_cap: float = 0.12
    fusion_weight: float = 0.35

    def __post_init__(self):
        object.__setattr__(self, "temperature", max(1e-4, self.temperature))
        object.__setattr__(self, "top_k", max(1, self.top_k))


# The four quality presets; pairs are (without, with) a graphics card.
QUALITY = {
    "fast": dict(model_name=("ViT-B-32", "ViT-B-32"), batch_size=(48, 96), image_max_side=(384, 384), multi_crop=False, multi_crop_views=1, video_frames=3, most_workers=6, confidence_threshold=0.28, min_margin=0.07, softmax_temperature=0.06, exemplar_boost=1.12, min_exemplar_similarity=0.30, exemplar_max_delta=0.10, text_prompt_fusion=0.55, text_prompt_max_pool=False, crop_score_max_pool=False, min_raw_similarity=0.17, min_raw_margin=0.025, top_k_softmax=8),
    "balanced": dict(model_name=("ViT-B-32", "ViT-B-16"), batch_size=(32, 64), image_max_side=(448, 448), multi_crop=True, multi_crop_views=3, video_frames=5, most_workers=8, confidence_threshold=0.26, min_margin=0.08, softmax_temperature=0.065, exemplar_boost=1.16, min_exemplar_similarity=0.31, exemplar_max_delta=0.11, text_prompt_fusion=0.62, text_prompt_max_pool=False, crop_score_max_pool=True, min_raw_similarity=0.19, min_raw_margin=0.03, top_k_softmax=10),
    "max": dict(model_name=("ViT-B-16", "ViT-L-14"), batch_size=(24, 36), image_max_side=(448, 512), multi_crop=True, multi_crop_views=5, video_frames=7, most_workers=12, confidence_threshold=0.22, min_margin=0.10, softmax_temperature=0.065, exemplar_boost=1.20, min_exemplar_similarity=0.32, exemplar_max_delta=0.12, text_prompt_fusion=0.68, text_prompt_max_pool=False, crop_score_max_pool=True, min_raw_similarity=0.20, min_raw_margin=0.035, top_k_softmax=12),
    "ultra": dict(model_name=("ViT-B-16", "ViT-L-14"), batch_size=(20, 28), image_max_side=(480, 576), multi_crop=True, multi_crop_views=9, video_frames=9, most_workers=12, confidence_threshold=0.20, min_margin=0.11, softmax_temperature=0.055, exemplar_boost=1.22, min_exemplar_similarity=0.34, exemplar_max_delta=0.12, text_prompt_fusion=0.75, text_prompt_max_pool=True, crop_score_max_pool=True, min_raw_similarity=0.23, min_raw_margin=0.04, top_k_softmax=15),
}
# Limits of the settings a user may give, and what holds where none is given: (least, most, default).
LIMITS = {
    "batch_size": (1, 512, 28), "image_max_side": (128, 768, 576), "multi_crop_views": (1, 12, 9), "video_frames": (1, 12, 9), "prefetch_workers": (1, 16, 8), "top_k_softmax": (2, 40, 12),
    "confidence_threshold": (0.05, 0.95, 0.20), "min_margin": (0.01, 0.5, 0.11), "softmax_temperature": (0.01, 0.2, 0.055), "exemplar_boost": (1.0, 2.5, 1.22),
    "min_exemplar_similarity": (0.15, 0.55, 0.32), "exemplar_max_delta": (0.02, 0.25, 0.12), "text_prompt_fusion": (0.0, 1.0, 0.75), "min_raw_similarity": (0.05, 0.45, 0.21), "min_raw_margin": (0.005, 0.2, 0.035),
}


def classify_settings(given: dict | None = None, card: bool = False, cpus: int = 8) -> dict:
    """All settings of the embedding classifier: the quality preset's, and the given ones (within their limits) before them; an unknown quality is ultra."""
    given = dict(given or {})
    quality = given.pop("quality", "ultra")
    preset = QUALITY.get(quality, QUALITY["ultra"])
    out = {k: v[card] if isinstance(v, tuple) else v for k, v in preset.items() if k != "most_workers"}
    out |= {"quality": quality if quality in QUALITY else "ultra", "prefetch_workers": min(preset["most_workers"], cpus), "pretrained": "openai", "device": "auto", "use_fp16": True, "vlm_fallback": True}
    for key, value in given.items():
        least, most, default = LIMITS.get(key, (None, None, None))
        if least is not None:
            value = max(least, min(most, (int if isinstance(default, int) else float)(value)))
        out[key] = value
    return out


def start_blockers(categories: int, encoder_ready: bool) -> list[str]:
    """What keeps an embedding run from starting."""
    return [name for name, missing in (("no_tags", categories <= 0), ("no_encoder", not encoder_ready)) if missing]
