"""Word lists, thresholds, patterns and formats that results depend on.

They are kept together, as plain text, so that a reader can compare them with the published behaviour at a glance.
"""

# --- fixed values: topic areas, weights and limits -------------------------------------------------------------
VERTICALS = ("business", "it", "medical")
POLARITY_WEIGHT = {"love": 0.8, "like": 0.5, "meh": 0.0, "dislike": -0.5, "mute": -1.0}
WEIGHTS = {"llm": 0.50, "taste": 0.20, "tag": 0.15, "source": 0.10, "fresh": 0.05}
TASTE_RAMP = 20
WATCH_BOOST = 0.15
PUSH_THRESHOLD = 0.55
TWEET_PUSH_THRESHOLD = 0.50
CHANNEL_MIN_SCORE = 0.60
GATE_MIN_SIMILARITY = 0.35
DEDUP_MIN_SIMILARITY = 0.88
SEARCH_MIN_SIMILARITY = 0.30
LEARNING_RATE = 0.10
FRESHNESS_TAU_HOURS = 48.0
UNDATED_AGE_HOURS = 24.0
REFINE_EVERY = 10
MAX_PUSH_PER_HOUR = 8
QUIET_HOURS = "0-8"
STAR_VERTICAL = "it"
DEFAULT_INTERVAL_SECONDS = 300
INGEST_AGE_FACTOR = 1.5
INGEST_MIN_WINDOW_HOURS = 24.0
RRF_K = 60
POOL = 80
ASK_ITEMS = 28
ASK_EXTRA = 15
WIKI_MAX_PAGES = 8
WIKI_MAX_CONTEXT = 12000
DIGEST_SEEN_KEEP = 80
RETENTION_DAYS = 14
STALL_HOURS, STALL_MIN_PENDING = 2, 30
SILENCE_HOURS = 6
MAX_ATTEMPTS, RECOVERY_CAP = 5, 20
RECOVERY_QUIET_MINUTES, REPUBLISH_PAUSE_MINUTES, STALE_MINUTES = 30, 30, 5
NORMAL_BATCH, RECOVERY_BATCH = 500, 50
CARD_FULL_CHARS, CARD_BRIEF_CHARS = 600, 60
ARTICLE_MIN_CHARS, ARTICLE_ENOUGH_CHARS = 400, 1200
SUMMARY_MIN_CHARS = 280
TITLE_MAX, TITLE_MODEL_MIN = 90, 80

# --- fixed values: trend periods as (window h, base h, base divisor, minimum count) -----------------------------
TREND_PERIODS = {"day": (24, 168, 7, 3), "week": (168, 672, 4, 5), "month": (720, 1440, 2, 8)}
BROAD_TAGS = (
    "ai", "business", "it", "medical", "tech", "technology", "news", "startups", "software",
    "health", "healthcare", "finance", "markets", "economy", "science",
)

# --- fixed values: user-visible texts ---------------------------------------------------------------------------
MUTE_PREFIX = "мьют темы: "
GATE_REASON = "низкая близость к профилям: %.2f (ближе всего %s)"
TITLE_FALLBACK_PREFIX = "Запись "
UNTITLED = "(без заголовка)"
WIKI_SAVED = "- сохранено: "
WIKI_FROM = " · источник: "
UNKNOWN_SOURCE = "источник"
AGE_NOW, AGE_MINUTE, AGE_HOUR, AGE_DAY, AGE_WEEK = "только что", "м", "ч", "д", "нед"
FOREIGN_SCRIPT_REASON = "чужое письмо"

# --- fixed values: URLs -----------------------------------------------------------------------------------------
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = (
    "fbclid", "gclid", "yclid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "cmpid", "spm",
)
URL_STOP_SEGMENTS = (
    "blog", "post", "posts", "article", "articles", "news", "p", "index",
    "en", "ru", "ru-ru", "en-us", "story", "read", "amp", "www",
)
SKIP_HOSTS = ("investing.com", "x.com", "twitter.com")
REDDIT_HOSTS = ("reddit.com", "www.reddit.com", "np.reddit.com", "new.reddit.com")
REPO_HOSTS = ("github.com", "www.github.com")
NOT_REPO_OWNERS = (
    "features", "topics", "trending", "collections", "events", "sponsors", "about",
    "pricing", "enterprise", "explore", "marketplace", "settings", "notifications",
    "orgs", "users", "search", "login", "join", "apps", "blog",
)
LISTING_RESERVED_PREFIXES = (
    "topics/", "collections/", "sponsors/", "orgs/", "users/", "features/", "apps/",
)

# --- fixed values: text that stands in for a missing body ------------------------------------------------------
JUNK_TEXTS = (
    "comments", "comment", "read more", "read the rest", "continue reading", "…", "...", "[link]", "link",
)

# --- fixed values: search words ---------------------------------------------------------------------------------
STOP_WORDS = (
    "для", "и", "в", "во", "на", "с", "со", "по", "из", "от", "к", "о", "об", "как", "что",
    "это", "the", "a", "an", "for", "of", "to", "and", "or", "in", "on", "with", "how", "what",
)
FRESH_WORDS = (
    "свежие", "свежий", "свежее", "новые", "новый", "последние", "последний", "fresh",
    "latest", "recent", "new", "newest",
)
PROJECT_WORDS = (
    "проект", "проекты", "репозитори", "репозиторий", "репа", "репы", "github", "гитхаб",
    "selfhost", "self", "селфхост", "селф", "хостинг", "хостинга", "selfhosted", "opensource",
    "опенсорс", "tool", "tools", "инструмент", "инструменты", "lib", "library", "библиотека",
)

# --- fixed values: incoming message categories ------------------------------------------------------------------
MESSAGE_CATEGORIES = {"news_ai": "ai", "news_tech": "tech"}

# --- fixed values: claim grounding ------------------------------------------------------------------------------
GENERIC_NAMES = (
    "open", "source", "opensource", "web", "api", "cloud", "self", "hosted", "selfhosted",
    "llm", "llms", "gpu", "cpu", "ram", "sdk", "cli", "ide", "http", "https", "url", "json",
    "yaml", "sql", "git", "pdf", "css", "html", "rest", "grpc", "docker", "linux", "ios",
    "and", "the", "for", "with", "from", "your", "you", "not", "все", "это",
)
NUMBER_WORDS = {
    "1": "one один одна одно одного одной одним одну",
    "2": "two два две двух двум двумя",
    "3": "three три трех трёх трем трём тремя",
    "4": "four четыре четырех четырёх четырем четырём четырьмя",
    "5": "five пять пяти пятью",
    "6": "six шесть шести шестью",
    "7": "seven семь семи семью",
    "8": "eight восемь восьми восьмью",
    "9": "nine девять девяти девятью",
    "10": "ten десять десяти десятью",
    "11": "eleven одиннадцать одиннадцати",
    "12": "twelve двенадцать двенадцати",
}
FACT_EDGE_CHARS = "._-+#,"
FOREIGN_SCRIPTS = "[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0590-\u05ff\u0600-\u06ff]"
DASHES = "[\u2010-\u2015\u2212\u00ad]"
SPACES = "[\u00a0\u2007\u2009\u202f\\s]+"

# --- fixed values: topic marks in order of precedence -----------------------------------------------------------
TOPIC_EMOJI = (
    ("🛡", ("security", "cybersecurity", "vulnerabilities", "supply-chain")),
    ("🕵️", ("privacy", "surveillance")),
    ("🦀", ("rust",)),
    ("🐍", ("python",)),
    ("🐹", ("golang", "go")),
    ("🐧", ("linux",)),
    ("🍎", ("apple", "macos", "ios")),
    ("🪟", ("windows",)),
    ("📱", ("android", "mobile")),
    ("🐳", ("docker",)),
    ("☸️", ("kubernetes",)),
    ("📜", ("javascript", "typescript")),
    ("🦾", ("robotics",)),
    ("🎮", ("gaming", "game-dev")),
    ("⛓", ("crypto", "blockchain")),
    ("👁", ("computer-vision",)),
    ("📐", ("mathematics", "math")),
    ("🩺", ("medical", "biotech", "health")),
    ("⚡", ("energy", "data-centers")),
    ("🖥", ("hardware", "nvidia", "chips", "semiconductors")),
    ("🗄", ("databases", "data-science")),
    ("🌐", ("networking", "cloudflare", "dns")),
    ("🐛", ("testing", "debugging")),
    ("🏎", ("performance",)),
    ("🔌", ("mcp", "api", "integrations")),
    ("🤖", ("ai-agents", "automation")),
    ("🔬", ("science", "ml-research", "research", "physics")),
    ("⚖️", ("politics", "policy", "regulation", "ethics", "law", "legal")),
    ("🎓", ("education",)),
    ("🏛", ("history",)),
    ("🧠", ("llm", "ai", "machine-learning", "reinforcement-learning")),
    ("🔓", ("open-source",)),
    ("🛠", ("devtools", "cli", "programming", "software-engineering", "productivity")),
    ("🕸", ("web", "frontend")),
    ("⚙️", ("backend", "systems", "distributed-systems", "compilers", "data")),
    ("☁️", ("devops", "infrastructure", "cloud", "aws", "gcp", "azure")),
    ("🚀", ("startups", "funding")),
    ("💼", ("business", "finance", "markets")),
)
REPO_EMOJI, TWEET_EMOJI, OTHER_EMOJI = "📦", "💬", "📌"

# --- fixed values: source labels by feed prefix -----------------------------------------------------------------
SOURCE_LABELS = (
    ("tw_", "🐦 @"), ("gh_stars_", "🐙 ★"), ("gh_repos_", "🐙 "), ("@", "✈️ @"),
)
REPO_LABEL, OTHER_LABEL = "🐙 GitHub", "📡 "
