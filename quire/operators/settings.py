"""Settings of a job, with fallbacks for what is not known."""

from __future__ import annotations

from dataclasses import dataclass, field

TRANSLATION_MODES = ("continuous_document", "page_by_page")
OUTPUT_MODES = ("readable", "faithful", "debug_markdown")


@dataclass(frozen=True)
class JobSettings:
    """A model that is not offered becomes the first that is, an unknown mode the first of its kind."""

    models: tuple[str, ...]
    model: str = ""
    chunk_size: int = 1800
    temperature: float = 0.0
    top_p: float = 1.0
    max_tokens: int = 2048
    output_mode: str = OUTPUT_MODES[0]
    translation_mode: str = TRANSLATION_MODES[0]
    ocr_mode: str = "full_page"
    profile: bool = False
    reuse_cache: bool = False
    ocr: dict = field(default_factory=lambda: {"max_tokens": 4096, "crops": (2, 6), "base_size": 1024, "image_size": 768, "ngram_size": 20, "ngram_window": 90})

    def __post_init__(self) -> None:
        if self.model not in self.models:
            object.__setattr__(self, "model", self.models[0])
        if self.translation_mode not in TRANSLATION_MODES:
            object.__setattr__(self, "translation_mode", TRANSLATION_MODES[0])
