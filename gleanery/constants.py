"""Fixed values.  Everything here must stay equal to what callers already rely on."""

from __future__ import annotations

# --- fixed values: main-content selectors, in order of preference ------------
WECHAT_SELECTORS = ("div#js_content", "div.rich_media_content")
WECHAT_URL_PART = "mp.weixin.qq.com"
COMMON_SELECTORS = (
    "article",
    "main",
    "[role='article']",
    "[itemprop='articleBody']",
    ".post-content",
    ".entry-content",
    ".article-content",
    ".article-body",
    ".article-detail",
    ".article-holder",
    ".post_body",
    ".markdown-body",
    ".Post-RichText",
    "#article_content",
    ".article-area",
    ".ssa-article",
)
FALLBACK_SELECTOR = "body(fallback)"

# --- fixed value: Unicode white space ------------------------------------------
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: sizes ------------------------------------------------------
MIN_CONTENT_BYTES = 100
# Limits of the service; nothing here applies them unless they are passed.
MAX_CONTENT_BYTES = 30_000
MAX_BODY_BYTES = 10 << 20
MAX_BATCH_URLS = 20
STORE_TTL_DAYS = 7
STORE_CAPACITY = 500
HASH_HEX_DIGITS = 16

# --- fixed values: domain classes ---------------------------------------------
TWITTER_DOMAINS = ("twitter.com", "x.com")
STEALTH_DOMAINS = ("mp.weixin.qq.com", "zhuanlan.zhihu.com", "juejin.cn", "mp.toutiao.com")

# --- fixed values: seconds between two requests to one host (min, max) ----------
DOMAIN_DELAYS = {
    "mp.weixin.qq.com": (2.0, 3.5),
    "zhuanlan.zhihu.com": (1.5, 2.5),
    "juejin.cn": (1.0, 1.8),
    "csdn.net": (0.5, 1.0),
    "sspai.com": (0.3, 0.8),
}
DEFAULT_DELAY = (0.5, 1.2)
GLOBAL_STEP_SECONDS = 1.01

# --- fixed values: modes, in the order they are tried per route class -----------
MODE_HTTP = "http"
MODE_STEALTH = "stealth"
MODE_FIRECRAWL = "firecrawl"
MODE_WEBPAGESNAP = "webpagesnap"
MODE_MARKDOWN_NEW = "markdown-new"
MODE_DEFUDDLE = "defuddle"
MODE_JINA = "jina"
MODE_BRAVE = "brave-search"
MODE_FXTWITTER = "fxtwitter"
ROUTE_PLANS = {
    "normal": ("http", "stealth", "firecrawl", "webpagesnap", "markdown-new", "defuddle", "jina", "brave-search"),
    "stealth": ("stealth", "firecrawl", "webpagesnap", "markdown-new", "defuddle", "jina", "brave-search"),
    "twitter": (
        "fxtwitter", "stealth", "firecrawl", "webpagesnap", "markdown-new", "defuddle", "jina", "brave-search",
    ),
}
ALL_MODES = (
    "http", "stealth", "firecrawl", "webpagesnap", "markdown-new", "defuddle", "jina", "brave-search", "fxtwitter",
)
# Modes that exist only when a browser or a key is configured.
OPTIONAL_MODES = ("stealth", "firecrawl", "brave-search")
BROWSER_ATTEMPTS = 2

# --- fixed values: the text of a failed row, per route class ---------------------
# (label, mode whose error is shown) pairs; a str in place of a mode is shown as it is.
FAILURE_TEXT = {
    "normal": (("http", "http"), ("webpagesnap", "webpagesnap"), ("markdownnew", "markdown-new"),
               ("defuddle", "defuddle"), ("jina", "jina")),
    "stealth": (("browser", "stealth"), ("firecrawl", "=skipped"), ("webpagesnap", "webpagesnap"),
                ("markdownnew", "markdown-new"), ("defuddle", "defuddle"), ("jina", "jina")),
    "twitter": (("fxtwitter", "fxtwitter"), ("browser", "="), ("webpagesnap", "webpagesnap"),
                ("markdownnew", "markdown-new"), ("defuddle", "defuddle"), ("jina", "jina")),
}
FAILURE_PREFIX = "all methods failed: "
NO_ERROR_TEXT = "<nil>"

# --- fixed values: selector names reported by the reader services -------------------
SELECTOR_OF_MODE = {
    "firecrawl": "firecrawl",
    "webpagesnap": "webpagesnap",
    "markdown-new": "markdown-new",
    "defuddle": "defuddle-reader",
    "jina": "jina-reader",
    "fxtwitter": "fxtwitter",
    "brave-search": "",
}

# --- fixed values: request addresses of the services (join keys only) ----------------
SERVICE_URLS = {
    "jina": "https://r.jina.ai",
    "defuddle": "https://defuddle.md",
    "markdown-new": "https://markdown.new",
    "webpagesnap": "https://webpagesnap.com/api/scrape",
    "brave-search": "https://api.search.brave.com/res/v1/web/search",
    "firecrawl": "https://api.firecrawl.dev/v1/scrape",
    "fxtwitter": "https://api.fxtwitter.com",
}
SEARCH_RESULT_COUNT = 5
TWEET_LINK_HOSTS = ("twitter.com", "x.com", "fxtwitter.com", "fixupx.com")
TWEET_SITE_NAME = "X (Twitter)"

# --- fixed values: messages ------------------------------------------------------------
MSG_URL_EMPTY = "URL 不能为空"
MSG_URL_FORMAT = "URL 格式错误: "
MSG_URL_SCHEME = ("不支持协议: ", "（仅支持 http/https）")
MSG_URL_NO_HOST = "域名不能为空"
MSG_URL_INVALID = "URL 校验失败: "
MSG_BATCH_TOO_LARGE = "最多支持 20 个 URL"
MSG_MISSING_URL = "缺少 url 参数"
MSG_RATE_LIMITED = "请求过于频繁，请稍后再试"
MSG_SUCCESS = "success"
MSG_SEARCH_EMPTY = "Brave Search 无结果"
MSG_SEARCH_JSON = "解析 Brave Search 响应失败"
MSG_TWEET_URL = "无法识别 Twitter/X URL 格式: "
TWEET_VIDEO_LABEL = "视频"
TWEET_LINK_LABEL = "查看原推文"
TWEET_COUNTER_FORMAT = "\n👍 %d  🔄 %d  💬 %d\n"

# --- fixed values: call log --------------------------------------------------------------
API_PATHS = ("/fetch", "/batch-fetch")
METERING_ZONE = "Asia/Shanghai"
INBOUND_CALLS_PER_SECOND = 5
OUTBOUND_REQUESTS_PER_SECOND = 5

# --- fixed values: validity rules by content type ---------------------------------------------
STRUCTURED_TYPES = ("application/json", "application/xml", "text/xml")
PLAIN_TEXT_TYPES = ("text/plain", "text/csv")
BINARY_TYPES = ("image/", "video/", "audio/", "application/pdf", "application/octet-stream")
MIN_PLAIN_TEXT_BYTES = 3
