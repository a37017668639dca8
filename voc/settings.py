"""Run parameters: everything that depends on whose reviews are analysed."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Names and limits of one analysis.

    ``brand`` is the name written into report texts, ``brand_terms`` are the lower-case names that count as
    mentions of the reviewed product (stop words for keywords, alternatives in the habit rules).
    ``english_stop_words`` replaces the default list of common words that are no keywords.
    """

    brand: str = "the app"
    brand_terms: tuple[str, ...] = ("app",)
    play_app_id: str = "app"
    app_store_id: str = "0"
    app_store_country: str = "in"
    search_terms: tuple[str, ...] = ("app", "quick commerce", "10 minute delivery", "grocery delivery app")
    play_limit: int | None = None       # no limit
    app_store_limit: int | None = None
    sources: tuple[str, ...] = ("play_store", "app_store", "reddit")
    english_stop_words: tuple[str, ...] | None = None

    @property
    def play_url(self) -> str:
        return f"https://play.google.com/store/apps/details?id={self.play_app_id}"

    @property
    def app_store_url(self) -> str:
        return f"https://apps.apple.com/{self.app_store_country}/app/id{self.app_store_id}"


DEFAULT = Settings()
