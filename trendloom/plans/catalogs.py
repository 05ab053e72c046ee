"""Declarative catalogs: phrases, weights, thresholds and name lists.

All values in this file are fixed values that results depend on; rules live elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# -- signals -------------------------------------------------------------------------------

#: group -> (weight, whole words only, phrases)
POSITIVE = {
    "launch": (3, True, (
        "just launched", "just shipped", "just released", "launched today", "shipping today", "open sourced", "open-sourced",
        "now open source", "introducing", "launching", "we launched", "i launched",
    )),
    "build": (2, True, (
        "I built", "we built", "built this", "built with", "I made", "my first", "side project", "weekend project", "new project",
        "hacked together", "spent the weekend building",
    )),
    "product": (2, True, (
        "new tool", "new app", "new SaaS", "developer tool", "AI tool", "open source alternative", "CLI tool", "open source",
        "self-hosted", "no-code tool",
    )),
    "release": (2, True, (
        "now available", "general availability", "out of beta", "first release", "initial release", "now live", "public beta",
    )),
    "version": (2, False, ("v1.0", "v0.1", "1.0.0", "release candidate")),
    "install": (2, True, (
        "npm install", "pip install", "cargo install", "go get", "brew install", "docker run", "composer require",
    )),
    "invite": (1, True, (
        "try it", "give it a try", "feedback welcome", "would love feedback", "check it out", "live demo", "MIT licensed",
        "apache licensed", "free and open",
    )),
}
NEGATIVE = {
    "hiring": (-5, True, (
        "we are hiring", "we're hiring", "now hiring", "join our team", "apply now", "job opening", "open role", "open position",
        "send your CV", "send your resume", "looking to hire",
    )),
    "tutorial": (-3, True, (
        "how to build", "step by step guide", "in this thread", "a thread", "tutorial series", "learn how to", "beginners guide",
        "complete guide", "here is how",
    )),
    "course": (-4, True, (
        "enroll now", "my course", "free course", "bootcamp", "early bird price", "discount code", "use code",
    )),
    "giveaway": (-5, True, (
        "retweet to win", "RT to win", "giveaway", "tag 3 friends", "like and retweet", "follow and retweet",
    )),
    "marketing": (-2, True, (
        "limited time offer", "sign up for our newsletter", "book a demo", "schedule a call", "lifetime deal",
    )),
}
POSITIVE_AR = {
    "launch": (3, True, ("أطلقت", "أطلقنا", "تم إطلاق", "مفتوح المصدر", "أعلن عن")),
    "product": (2, True, ("أداة جديدة", "مشروع جديد", "تطبيق جديد", "مكتبة برمجية")),
}
STRENGTHS = {"none": 0, "weak": 1, "medium": 3, "strong": 5}
STRUCTURAL = {"repository_link": 3, "any_link": 1, "repost": -4}


@dataclass(frozen=True)
class Signal:
    phrase: str
    weight: int
    group: str
    language: str | None = None
    whole_word: bool = True
    case_sensitive: bool = False

    def __post_init__(self) -> None:
        if not self.phrase.strip():
            raise ValueError("a signal needs a phrase")
        if self.weight == 0:
            raise ValueError("a signal needs a weight other than 0")


def build_signals(groups: dict, language: str | None = None) -> list[Signal]:
    return [Signal(p, weight, group, language, whole) for group, (weight, whole, phrases) in groups.items() for p in phrases]


def default_signals() -> list[Signal]:
    """Positive, negative, then Arabic signals, in this order."""
    return build_signals(POSITIVE) + build_signals(NEGATIVE) + build_signals(POSITIVE_AR, "ar")


# -- categories, types, technologies -------------------------------------------------------

CATEGORIES = {
    "ai": ("artificial intelligence", "machine learning", "ml", "llm", "genai", "ai-ml"),
    "saas": ("software as a service", "saas product", "subscription"),
    "open-source": ("oss", "open source project", "foss"),
    "developer-tools": ("devtools", "developer tooling", "dev tool", "tooling"),
    "web-app": ("web application", "webapp", "website", "web"),
    "mobile-app": ("mobile", "ios app", "android app", "mobile application"),
    "library": ("package", "sdk", "module"),
    "framework": ("meta-framework", "full-stack framework"),
    "cli": ("command line", "command-line tool", "terminal tool"),
    "devops": ("infrastructure", "infra", "platform engineering", "ci-cd", "observability"),
    "data": ("database", "analytics", "data engineering", "etl"),
    "security": ("infosec", "appsec", "cybersecurity"),
    "other": (),
}
FALLBACK_CATEGORY = "other"
PROJECT_TYPES = ("application", "library", "framework", "cli", "service", "extension", "template", "dataset", "model", "other")


@dataclass(frozen=True)
class Technology:
    slug: str
    name: str
    kind: str
    aliases: tuple[str, ...]
    case_sensitive: bool = False


TECHNOLOGIES = (
    Technology("typescript", "TypeScript", "language", ("typescript", "ts")),
    Technology("javascript", "JavaScript", "language", ("javascript",)),
    Technology("python", "Python", "language", ("python", "py", "pypi")),
    Technology("php", "PHP", "language", ("php",)),
    Technology("go", "Go", "language", ("Golang", "golang", "Go modules", "go get", "pkg.go.dev"), True),
    Technology("rust", "Rust", "language", ("Rust", "crates.io", "cargo install", "rustlang"), True),
    Technology("ruby", "Ruby", "language", ("ruby", "rubygems")),
    Technology("java", "Java", "language", ("java",)),
    Technology("swift", "Swift", "language", ("swift", "swiftui")),
    Technology("kotlin", "Kotlin", "language", ("kotlin",)),
    Technology("elixir", "Elixir", "language", ("elixir", "phoenix framework")),
    Technology("vue", "Vue", "framework", ("vue", "vuejs", "vue.js")),
    Technology("nuxt", "Nuxt", "framework", ("nuxt", "nuxtjs", "nuxt.js")),
    Technology("react", "React", "framework", ("react", "reactjs", "react.js")),
    Technology("nextjs", "Next.js", "framework", ("next.js", "nextjs")),
    Technology("svelte", "Svelte", "framework", ("svelte", "sveltekit")),
    Technology("angular", "Angular", "framework", ("angular",)),
    Technology("tailwind", "Tailwind CSS", "framework", ("tailwind", "tailwindcss")),
    Technology("astro", "Astro", "framework", ("astro",)),
    Technology("laravel", "Laravel", "framework", ("laravel",)),
    Technology("django", "Django", "framework", ("django",)),
    Technology("fastapi", "FastAPI", "framework", ("fastapi",)),
    Technology("rails", "Ruby on Rails", "framework", ("rails", "ruby on rails")),
    Technology("nodejs", "Node.js", "runtime", ("node.js", "nodejs", "npm install")),
    Technology("deno", "Deno", "runtime", ("deno",)),
    Technology("bun", "Bun", "runtime", ("bun.sh", "bunjs")),
    Technology("spring", "Spring", "framework", ("spring boot",)),
    Technology("postgresql", "PostgreSQL", "database", ("postgresql", "postgres", "psql")),
    Technology("mysql", "MySQL", "database", ("mysql", "mariadb")),
    Technology("mongodb", "MongoDB", "database", ("mongodb", "mongo")),
    Technology("redis", "Redis", "database", ("redis",)),
    Technology("sqlite", "SQLite", "database", ("sqlite",)),
    Technology("supabase", "Supabase", "platform", ("supabase",)),
    Technology("clickhouse", "ClickHouse", "database", ("clickhouse",)),
    Technology("duckdb", "DuckDB", "database", ("duckdb",)),
    Technology("docker", "Docker", "tool", ("docker", "dockerfile", "docker run")),
    Technology("kubernetes", "Kubernetes", "tool", ("kubernetes", "k8s")),
    Technology("aws", "AWS", "platform", ("aws", "amazon web services", "lambda")),
    Technology("cloudflare", "Cloudflare", "platform", ("cloudflare", "workers.dev")),
    Technology("vercel", "Vercel", "platform", ("vercel",)),
    Technology("terraform", "Terraform", "tool", ("terraform",)),
    Technology("openai", "OpenAI", "ai", ("openai", "gpt-4", "gpt-4o", "chatgpt api")),
    Technology("claude", "Claude", "ai", ("claude", "anthropic")),
    Technology("langchain", "LangChain", "ai", ("langchain",)),
    Technology("ollama", "Ollama", "ai", ("ollama",)),
    Technology("huggingface", "Hugging Face", "ai", ("hugging face", "huggingface")),
    Technology("pytorch", "PyTorch", "ai", ("pytorch",)),
)

# -- URLs ----------------------------------------------------------------------------------

TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "utm_social", "utm_brand",
    "fbclid", "gclid", "dclid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "referrer", "source",
    "s", "t", "si", "feature", "spm", "yclid", "_hsenc", "_hsmi",
)
CANONICAL_REPOSITORY_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org")
REPOSITORY_HOSTS = (*CANONICAL_REPOSITORY_HOSTS, "sr.ht")
SHORTENERS = (
    "t.co", "bit.ly", "buff.ly", "tinyurl.com", "ow.ly", "lnkd.in", "goo.gl", "is.gd", "rebrand.ly", "cutt.ly", "shorturl.at",
)
RESERVED_OWNERS = ("orgs", "topics", "features", "explore", "sponsors", "settings")
DEMO_HOSTS = (
    "vercel.app", "netlify.app", "pages.dev", "fly.dev", "railway.app", "streamlit.app", "huggingface.co", "replit.app", "surge.sh",
    "github.io", "gitlab.io", "onrender.com",
)
DEMO_PATHS = ("/demo", "/playground", "/try", "/live", "/sandbox")

# -- text ----------------------------------------------------------------------------------

INVISIBLE = "\u200b\u200c\u200d\ufeff\u2060\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u00ad"
NAME_PLACEHOLDERS = ("unknown", "n/a", "na", "none", "untitled", "not specified", "null")

# -- collection ----------------------------------------------------------------------------

QUERY_LIMIT = 512
QUERY_MODIFIERS = ("-is:retweet", "-is:reply", "has:links")
QUERY_GROUPS = {
    "repo-launch": ("A", ('(url:"github.com" OR url:"gitlab.com")',), (
        "just launched", "just shipped", "just released", "open sourced", "open-sourced", "open source", "introducing", "now open source",
    )),
    "release": ("B", (), ("v1.0", "now available", "general availability", "out of beta", "first release", "initial release", "now live")),
    "build-in-public": ("C", (), ("I built", "built this", "my first", "side project", "weekend project", "new project", "built with", "shipped it")),
    "devtools": ("D", (), (
        "developer tool", "CLI tool", "open source alternative", "new tool", "new app", "new SaaS", "AI tool", "npm install", "pip install", "SDK",
    )),
}

# -- states --------------------------------------------------------------------------------

STATUSES = ("raw", "normalized", "deduplicated", "filtered", "pending_classification", "classified", "rejected", "published", "aged_out", "purged")
SURVIVOR_STATUSES = ("deduplicated", "filtered", "pending_classification", "classified", "published")
REMOVAL_EVENTS = ("deleted", "bounced", "suspended", "protected", "deactivated")
PERMANENT_EVENTS = ("deleted", "bounced")
COMPLIANCE_EVENTS = (*REMOVAL_EVENTS, "scrub_geo")
STAGES = ("collect", "normalize", "deduplicate", "filter", "classify", "extract", "enrich", "score", "comply")

# -- scoring -------------------------------------------------------------------------------


@dataclass(frozen=True)
class ScoringConfig:
    weights: dict[str, float] = field(default_factory=lambda: {"engagement": 0.35, "recency": 0.25, "confidence": 0.15, "github": 0.15, "growth": 0.10})
    scale: float = 100.0
    sparse_threshold: int = 2
    sparse_dampener: float = 0.85
    interactions: dict[str, float] = field(default_factory=lambda: {"like": 1.0, "repost": 3.0, "reply": 2.0, "quote": 3.0, "bookmark": 4.0})
    absolute_cap: float = 1200.0
    rate_cap: float = 0.10
    rate_share: float = 0.55
    reach_floor: float = 250.0
    anomaly_rate: float = 0.5
    anomaly_dampener: float = 0.5
    half_life_hours: float = 36.0
    window_hours: float = 168.0
    grace_hours: float = 4.0
    classification_share: float = 0.7
    extraction_share: float = 0.3
    star_cap: float = 5000.0
    fork_cap: float = 500.0
    star_share: float = 0.45
    fork_share: float = 0.20
    freshness_share: float = 0.35
    stale_after_days: float = 180.0
    rate_per_hour_cap: float = 40.0
    minimum_interval_hours: float = 1.0

    def normalised(self) -> dict[str, float]:
        """Weights rescaled to sum to 1."""
        if any(w < 0 for w in self.weights.values()):
            raise ValueError("weights cannot be negative")
        total = sum(self.weights.values())
        if total <= 0:
            raise ValueError("at least one weight must be positive")
        return {k: w / total for k, w in self.weights.items()}


# -- what a score report says (fixed values) -----------------------------------------------

SPARSE_NOTE = "only %d of %d components available; score damped by %.2f"
MISSING_NOTE = "%s unavailable: %s"
WHY = {
    "engagement none": "No engagement metrics recorded for this post yet.",
    "engagement absolute": "Weighted engagement %.1f (absolute only; author reach unknown).",
    "engagement rate": "Weighted engagement %.1f (absolute %.2f) at a rate of %.4f per follower (rate term %.2f)%s.",
    "engagement anomaly": " — engagement rate %.2f exceeds %.2f; rate term damped",
    "recency past": "%.1f hours old, past the %.0f-hour window.",
    "recency grace": "%.1f hours old, inside the %.0f-hour grace window.",
    "recency": "%.1f hours old; half-life %.0f hours gives %.3f.",
    "confidence none": "No classification or extraction confidence recorded.",
    "confidence": "%.3f from %s.",
    "github none": "No repository data (project has no repository link, or enrichment has not run).",
    "github": "%d stars (%.2f), %d forks (%.2f), freshness %s.",
    "growth few": "Fewer than two metric snapshots; no trajectory exists yet.",
    "growth close": "Snapshots only %.2f hours apart; too close together to measure a rate.",
    "growth": "+%d engagement over %.1f hours = %.2f/hour (%.2f).",
}
CONFIDENCE_BASES = ("classification confidence only", "extraction confidence only", "blended classification and extraction confidence")

#: Minimum sample, and change in per cent below which a trend is steady.
TREND_MINIMUM_SAMPLE = 8
TREND_STEADY_PERCENT = 5.0
SERIES_MAX_DAYS = 400
CLASSIFY_MINIMUM_CONFIDENCE = 0.75
EXTRACT_MINIMUM_CONFIDENCE = 0.6
MAX_NAME, MAX_DESCRIPTION, MAX_REASON, MAX_POST = 120, 400, 500, 4000
#: Categories that an earlier catalog had, and what they are called now.
CATEGORY_RENAMES = {"ai-ml": "ai", "devtools": "developer-tools", "web": "web-app", "mobile": "mobile-app", "infra": "devops"}

# -- redaction (fixed values) --------------------------------------------------------------

SENSITIVE_KEYS = (
    "authorization", "auth", "bearer", "bearer_token", "token", "access_token", "api_key", "apikey", "key", "secret",
    "client_secret", "consumer_secret", "password", "x_api_bearer_token",
)
SECRET_PATTERNS = (
    (r"(?i)(Bearer\s+)[A-Za-z0-9\-._~+/=%]{8,}", "$1[redacted]"),
    (r"(?i)([?&](?:access_token|bearer_token|token|api_key|key|secret)=)[^&\s]+", "$1[redacted]"),
    (r"(AAAAAAAAAAAAAAAAAAAAA)[A-Za-z0-9%._-]{10,}", "[redacted]"),
)
