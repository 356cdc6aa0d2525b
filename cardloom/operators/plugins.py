"""Site policies and content profiles: user hooks as column expressions, folded into the plan by priority."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from ..functions import columns as C


SCALARS = {"focus_title_nearest_body": "boolean", "timeout_ms": "int", "max_scroll_steps": "int", "scroll_delay_ms": "int"}
LISTS = ("main_selectors", "remove_selectors", "noise_keywords", "main_keywords", "drop_tags")


@dataclass(frozen=True)
class ContentRules:
    """What a profile, or a caller, asks of capture and content extraction."""

    focus_title_nearest_body: bool | None = None
    timeout_ms: int | None = None
    max_scroll_steps: int | None = None
    scroll_delay_ms: int | None = None
    main_selectors: tuple[str, ...] = ()
    remove_selectors: tuple[str, ...] = ()
    noise_keywords: tuple[str, ...] = ()
    main_keywords: tuple[str, ...] = ()
    drop_tags: tuple[str, ...] = ()

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(getattr(self, k)).cast(t) for k, t in SCALARS.items()} | {k: F.array(*[F.lit(x) for x in getattr(self, k)]).cast("array<string>") for k in LISTS}


class Plugin(ABC):
    id: str = ""
    priority: int = 0

    @abstractmethod
    def matches(self, url: Column, provider: Column) -> Column: ...


class SitePolicy(Plugin):
    """Every hook gets the columns of its stage by name and returns those it changes."""

    def refine_options(self, url: Column, values: dict[str, Column]) -> dict[str, Column]:
        return {}

    def refine_metadata(self, url: Column, values: dict[str, Column]) -> dict[str, Column]:
        return {}

    def refine_classification(self, url: Column, values: dict[str, Column]) -> dict[str, Column]:
        return {}

    def refine_capability(self, url: Column, values: dict[str, Column]) -> dict[str, Column]:
        return {}

    def refine_card(self, url: Column, values: dict[str, Column]) -> dict[str, Column]:
        return {}


class ContentProfile(Plugin):
    @abstractmethod
    def rules(self) -> ContentRules: ...


@dataclass
class Registry:
    """Plug-ins, highest priority first, then by id."""

    plugins: list[Plugin] = field(default_factory=list)

    def ordered(self) -> list[Plugin]:
        return sorted(self.plugins, key=lambda p: (-p.priority, p.id.casefold(), p.id))

    def fold(self, hook: str, url: Column, provider: Column, values: dict[str, Column]) -> dict[str, Column]:
        """Left fold of one hook over all matching policies."""
        for p in self.ordered():
            if isinstance(p, SitePolicy):
                match = F.coalesce(p.matches(url, provider), F.lit(False))
                values = values | {k: F.when(match, v).otherwise(values[k]) for k, v in getattr(p, hook)(url, values).items()}
        return values

    def rules(self, url: Column, provider: Column, base: dict[str, Column]) -> dict[str, Column]:
        """The rules in base with those of all matching profiles: of a scalar the first given counts, lists are joined without repeats.

        They are columns, so that every page gets the rules of its own address within the plan.
        """
        out = dict(base)
        for p in self.ordered():
            if isinstance(p, ContentProfile):
                match, more = F.coalesce(p.matches(url, provider), F.lit(False)), p.rules().columns()
                for k in SCALARS:
                    out[k] = F.coalesce(out[k], F.when(match, more[k]))
                for k in LISTS:
                    if getattr(p.rules(), k):
                        out[k] = F.when(match, F.array_distinct(F.concat(out[k], more[k]))).otherwise(out[k])
        return out

    def options(self, url: Column, provider: Column, base: dict[str, Column]) -> dict[str, Column]:
        """rules, and then what the matching policies make of them."""
        return self.fold("refine_options", url, provider, self.rules(url, provider, base))


def video_id(url: Column) -> Column:
    """The id of a video on the best-known video site, from its short, watch, shorts, live and embed addresses."""
    host, path = C.url_host(url), C.url_path(url)
    query = F.url_decode(F.nullif(F.regexp_extract(url, r"[?&]v=([^&#]*)", 1), F.lit("")))
    raw = F.when(host.rlike(r"(^|\.)youtu\.be$"), F.try_element_at(C.segments(path), F.lit(1))).when(path == "/watch", query).otherwise(F.nullif(F.regexp_extract(path, r"^/(?:shorts|embed|live)/([^/]+)", 1), F.lit("")))
    return F.when(host.rlike(r"(^|\.)youtube\.com$|(^|\.)youtu\.be$") & F.trim(raw).rlike(r"^[a-zA-Z0-9_-]{6,20}$"), F.trim(raw))


class VideoSitePolicy(SitePolicy):
    """A page of the video site is a video that plays where it is embedded."""

    id, priority = "video-site", 120

    def matches(self, url: Column, provider: Column) -> Column:
        return video_id(url).isNotNull()

    @staticmethod
    def _embed(url: Column) -> Column:
        return F.concat(F.lit("https://www.youtube.com/embed/"), video_id(url))

    def refine_metadata(self, url, values):
        return {"player_url": F.coalesce(values["player_url"], self._embed(url)), "og_type": F.coalesce(values["og_type"], F.lit("video.other"))}

    def refine_classification(self, url, values):
        return {"resource_type": F.lit("video"), "page_kind": F.lit("atomic")}

    def refine_capability(self, url, values):
        return {"embed_url": F.coalesce(values["embed_url"], self._embed(url)), "embeddable": F.lit(True), "playable": F.lit(True), "interaction_mode": F.lit("embeddable")}


class MapSitePolicy(SitePolicy):
    """A map page with a player address can be embedded whatever its type."""

    id, priority = "map-site", 110

    def matches(self, url: Column, provider: Column) -> Column:
        return C.url_host(url).rlike(r"(^|\.)map\.naver\.com$")

    def refine_capability(self, url, values):
        player = values["player_url"]
        good = F.coalesce(C.is_web_url(player), F.lit(False))
        return {"embed_url": F.when(good, player).otherwise(values["embed_url"]), "embeddable": F.when(good, True).otherwise(values["embeddable"]), "interaction_mode": F.when(good, "embeddable").otherwise(values["interaction_mode"])}


class VideoSiteProfile(ContentProfile):
    id, priority = "video-site-content", 120

    def matches(self, url: Column, provider: Column) -> Column:
        return (provider == "youtube") | C.url_host(url).rlike(r"(^|\.)youtube\.com$|(^|\.)youtu\.be$")

    def rules(self) -> ContentRules:
        # Fixed values.
        return ContentRules(
            main_selectors=("#primary", "#primary-inner", "#content", "main", '[role="main"]'),
            remove_selectors=("#masthead-container", "#guide", "#secondary", "#related", "#chat", "ytd-mini-guide-renderer", "ytd-merch-shelf-renderer"),
            noise_keywords=("related", "recommend", "sidebar", "shorts", "ad", "sponsored"),
            main_keywords=("content", "description", "watch", "comment", "본문", "댓글"),
        )


class MapSiteProfile(ContentProfile):
    id, priority = "map-site-content", 110

    def matches(self, url: Column, provider: Column) -> Column:
        return (provider == "naver") & C.url_host(url).rlike(r"(^|\.)map\.naver\.com$")

    def rules(self) -> ContentRules:
        # Fixed values.
        return ContentRules(
            focus_title_nearest_body=True,
            main_selectors=("#app", "#content", "main", '[role="main"]', '[class*="place"]'),
            remove_selectors=("header", "nav", "footer", '[class*="toolbar"]', '[class*="control"]', '[class*="floating"]'),
            noise_keywords=("gnb", "lnb", "snb", "menu", "banner", "ad", "광고", "추천"),
            main_keywords=("place", "content", "detail", "panel", "본문", "리뷰", "주소"),
        )


DEFAULTS = Registry([VideoSitePolicy(), MapSitePolicy(), VideoSiteProfile(), MapSiteProfile()])


def registry(*own: Plugin) -> Registry:
    """The built-in plug-ins with one's own."""
    return Registry([*own, *DEFAULTS.plugins])
