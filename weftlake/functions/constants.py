"""Word lists, patterns and tables that results depend on, stated as they are."""

STOP_WORDS = (
    "the", "and", "for", "are", "was", "were", "this", "that", "with", "from", "what", "how", "why",
    "who", "when", "has", "have", "had", "its", "about", "into", "over", "than", "then", "they", "them",
)
NAV = r"(?i)/(login|sign-?in|sign-?up|about|contact|privacy|terms|category|categories|tag|tags|author|search|advertise|subscribe|account|cart|pricing)(/|$|\?)|^https?://[^/]+/?$"
AGGREGATOR = r"(?i)(^|[./])(google|bing|duckduckgo|youtube|reddit|facebook|twitter|x|linkedin|instagram|pinterest)\.[a-z]"
HOMEPAGE = r"(?i)^https?://[^/]+/?$"
BLOCKED = r"(?i)verify you are human|attention required|cloudflare|access denied|request blocked|enable javascript|unusual traffic|just a moment|checking your browser"
PAYWALL = r"(?i)subscribe to (read|continue)|already a subscriber|metered|this article is for subscribers|to continue reading|create a free account to|sign in to read"
DATED = r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+20\d\d|\b\d+\s+(?:hours?|days?|minutes?)\s+ago\b|20\d\d-\d\d-\d\d"
FIRST_DATE = r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+20\d\d|20\d\d-\d\d-\d\d"
FRAMEWORKS = r"(?i)(?:react|vue|angular|svelte|next|nuxt|gatsby|remix)[\w.-]*\.js"
EMPTY_ROOT = r"""(?i)<div\s+id=["'](?:root|app|__next|__nuxt)["']\s*>\s*</div>"""
NOSCRIPT = r"(?is)<noscript[^>]*>.{100,}</noscript>"
SUBSTANTIAL = r"(?i)<(?:p|h[1-6]|li|td|article|section|main)[^>]*>[^<]{50,}</"
INLINE_LOGIC = r"(?is)<script[^>]*>.{200,}</script>"
APP_PATH = r"/(?:app|dashboard|settings|console|portal)\b"
APP_HOSTS = ("app.", "dashboard.", "console.", "portal.")
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{FF00}-\x{FFEF}]"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")
LADDER = ("direct", "stealth-retry", "logged-in", "wayback", "archive-today", "reader")
REMOVED_TAGS = ("script", "style", "noscript", "iframe", "svg", 'link[rel="stylesheet"]', "meta")
NOISE = (
    '[class*="cookie"]', '[class*="banner"]', '[class*="popup"]', '[class*="modal"]', '[class*="overlay"]',
    '[class*="newsletter"]', '[class*="subscribe"]', '[class*="social"]', '[class*="share"]', '[class*="sidebar"]',
    '[class*="widget"]', '[class*="advertisement"]', '[class*="ad-"]', '[class*="tracking"]', '[class*="analytics"]',
    '[id*="cookie"]', '[id*="banner"]', '[id*="popup"]', '[id*="modal"]', '[id*="overlay"]', '[id*="newsletter"]',
    '[id*="sidebar"]', '[id*="advertisement"]', '[aria-hidden="true"]', "[hidden]", "nav", "footer", "header",
    '[role="banner"]', '[role="navigation"]', '[role="complementary"]', '[role="contentinfo"]',
)
CATEGORIES = (
    "Armed conflicts and attacks", "Arts and culture", "Business and economy", "Disasters and accidents",
    "Health and environment", "International relations", "Law and crime", "Politics and elections",
    "Science and technology", "Sports",
)
RRF_K, PRUNE_DAYS = 60, 90
#: White space as ECMAScript's \s and trim see it.
JS_SPACE = r"[\x09-\x0D\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same sets for Java's patterns, which test a class range by range: most characters are told by the first. A word is a run of other characters.
JS_SPACE_FAST, CJK_FAST = r"[[^\x21-\x7E]&&" + JS_SPACE + "]", r"[\x{3000}-\x{FFEF}&&" + CJK + "]"
JS_WORD_FAST = r"(?:[\x21-\x7E]++[^" + JS_SPACE[1:-1] + "]*+|[^" + JS_SPACE[1:-1] + "]++)"
#: DATED and FIRST_DATE for Java's patterns: a place where no month begins is left after three letters.
_MAY_BEGIN = "(?i)(?=[jfmasond][aepuco][nbrylgptvc]|[0-9])"
DATED_FAST, FIRST_DATE_FAST = (f"{_MAY_BEGIN}(?:{x.removeprefix('(?i)')})" for x in (DATED, FIRST_DATE))
VIDEO_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com", "youtu.be")
#: The feeds of a subject, the searches that go with them ({M} month, {Y} year), and the entities tracked by default.
DOMAIN_FEEDS = {
    "ai": ("https://news.ycombinator.com/rss", "http://export.arxiv.org/rss/cs.AI", "https://www.reddit.com/r/LocalLLaMA/.rss", "https://www.reddit.com/r/MachineLearning/.rss"),
    "markets": ("https://www.federalreserve.gov/feeds/press_all.xml", "https://www.reddit.com/r/economics/.rss", "https://www.reddit.com/r/StockMarket/.rss"),
    "youtube": ("https://www.tubefilter.com/feed/", "https://www.reddit.com/r/PartneredYoutube/.rss", "https://www.reddit.com/r/NewTubers/.rss"),
    "crypto": ("https://www.coindesk.com/arc/outboundfeeds/rss/", "https://cointelegraph.com/rss", "https://www.reddit.com/r/CryptoCurrency/.rss"),
}
DOMAIN_SEARCHES = {
    "ai": ("major AI model release announcement {M} {Y}", "AI company breakthrough record {M} {Y}"),
    "markets": ("stock market Federal Reserve decision {M} {Y}", "record market move {M} {Y}"),
    "youtube": ("YouTube subscriber milestone record {M} {Y}", "YouTube creator record announcement {M} {Y}"),
    "crypto": ("cryptocurrency bitcoin record milestone {M} {Y}", "major crypto announcement {M} {Y}"),
}
WATCHLIST = (
    ("MrBeast", "person", ("Jimmy Donaldson", "Mr Beast"), ("youtube",)),
    ("Anthropic", "org", ("Claude",), ("ai",)),
    ("OpenAI", "org", ("ChatGPT", "GPT-5"), ("ai",)),
    ("Google DeepMind", "org", ("Gemini",), ("ai",)),
    ("xAI", "org", ("Grok",), ("ai",)),
    ("Nvidia", "org", ("NVDA",), ("ai", "markets")),
    ("Federal Reserve", "org", ("FOMC", "the Fed"), ("markets",)),
    ("Bitcoin", "ticker", ("BTC",), ("crypto",)),
)
