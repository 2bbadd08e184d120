"""Word lists, patterns, limits and messages that results depend on.

Results are only comparable between runs and between systems when these values are
the same, so they are stated here once, as plain text, and nowhere else.
"""

# ---------------------------------------------------------------- fixed values: page model
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr",
]
RAW_TEXT_TAGS = ["script", "style"]

# A paragraph ends where one of these starts or ends.
PARAGRAPH_ENDERS = [
    "address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt",
    "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "html", "li", "main", "nav", "ol", "pre", "section", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
]

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

# Classes of elements in the HTML standard: boundaries of scopes, special and formatting elements, ends that may be left out.
SCOPE_TAGS = ["applet", "caption", "html", "marquee", "object", "table", "td", "template", "th"]
SPECIAL_TAGS = [
    "address", "applet", "article", "aside", "blockquote", "body", "button", "caption", "center", "colgroup",
    "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "html", "iframe", "li", "listing", "main", "marquee", "menu", "nav", "noembed",
    "noframes", "noscript", "object", "ol", "p", "plaintext", "pre", "search", "section", "select",
    "summary", "table", "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "title",
    "tr", "ul", "xmp",
]
FORMATTING_TAGS = ["a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"]
OPTIONAL_END_TAGS = [
    "caption", "colgroup", "dd", "dt", "head", "li", "optgroup", "option", "p", "rp", "rt", "tbody", "td", "tfoot", "th", "thead", "tr",
]

# Named character references that are decoded; the ampersand itself is decoded last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0",
    "&copy;": "©", "&reg;": "®", "&trade;": "™", "&middot;": "·", "&bull;": "•",
    "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’",
    "&ldquo;": "“", "&rdquo;": "”", "&laquo;": "«", "&raquo;": "»", "&lsaquo;": "‹",
    "&rsaquo;": "›", "&euro;": "€", "&pound;": "£", "&yen;": "¥", "&sect;": "§",
    "&deg;": "°", "&times;": "×",
}

# ---------------------------------------------------------------- fixed values: noise
NOISE_TAGS = ["script", "style", "svg", "nav", "footer"]
NOISE_ROLES = ["banner", "navigation", "contentinfo"]
NOISE_CLASS_PARTS = ["cookie", "consent", "advert", "ad-"]
NOISE_ID_PARTS = ["cookie", "consent"]
NOISE_CLASSES = [  # (tag or None, class)
    ("aside", "widget"),
    (None, "pagetop"),
    (None, "yclinks"),
    ("span", "sitebit"),
]

# ---------------------------------------------------------------- fixed values: main content
MAIN_MIN_TEXT = 80
CANDIDATE_MIN_TEXT = 120
HEADING_BONUS = 500
THREAD_HOSTS = ["news.ycombinator.com", "news.ycombinator.com."]
TRUNCATION_MARK = "\n\n…"
USABLE_MIN_CHARS = 40

# ---------------------------------------------------------------- fixed values: actions
NOISE_LABEL = r"(?i)cookie|consent|accept all|gdpr|subscribe|newsletter|share on|sign in|log in"
SEARCH = r"(?i)search|query|q\b"
PAGINATION = r"(?i)next|prev|previous|page \d|›|»|‹|«"
LOCAL_ONCLICK = (
    r"(?i)openCity|openTab|showTab|classList|\.display\s*=|\.style\.|toggle|accordion"
)
LOCATION_HREF = r"""location\.href\s*=\s*['"]([^'"]+)"""
MAX_ACTIONS = 15
MAX_OPTIONS = 20
# Descriptions of actions; %s are label, method and target, or the section name.
DESCRIBE_SEARCH = "Submit a search query and load matching results."
DESCRIBE_HOST_SEARCH = "Submit a search query and load matching products."
DESCRIBE_FORM = "Submit the '%s' form (%s %s)."
DESCRIBE_SECTION = "Switch to in-page section '%s' (local DOM effect)."
DESCRIBE_LOCAL_LINK = "Activate '%s' for a local in-page UI change."
DESCRIBE_PAGINATION = "Navigate to '%s' (pagination)."
DESCRIBE_NAVIGATION = "Navigate via site navigation to '%s'."
DESCRIBE_LINK = "Follow link to '%s'."
DESCRIBE_LOCAL_BUTTON = "Click '%s' to trigger a local in-page UI change."
DESCRIBE_BUTTON = "Click the '%s' button (may trigger in-page JS)."
DESCRIBE_SUBMIT = "Activate '%s' control."
# host, pattern the page must show, path of the search form, label
HOST_SEARCH_RULES = [
    ("books.toscrape.com", r"(?i:oscar\.search\.init)|product_pod", "/catalogue/search", "Search"),
]

# ---------------------------------------------------------------- fixed values: routing
FRAMEWORK_SIGNALS = (
    r"(?i)__NEXT_DATA__|__NUXT__|ng-app|data-reactroot|data-v-app|"
    r' id="root"[^>]*>\s*</div>|id="app"[^>]*>\s*</div>|'
    r"window\.__INITIAL_STATE__|webpackJsonp|vite"
)
APP_SHELL = r"""(?i)<div[^>]+id=["'](?:root|app|__next)["'][^>]*>\s*</div>"""
SHELL_MIN_TEXT = 200
SHORT_MARKDOWN = 80

# ---------------------------------------------------------------- fixed values: fetch and render errors
FETCH_ERRORS = {  # code: (message, recoverable); %s is the time limit, the reason or the status
    "timeout": ("Request timed out after %sms", True),
    "redirect_loop": ("Too many redirects", False),
    "network_error": ("%s", True),
    "http_429": ("Rate limited by target", True),
    "http_5xx": ("Target returned HTTP %s", True),
    "http_4xx": ("Target returned HTTP %s", False),
}
RENDER_ERRORS = {  # code: (message, recoverable); %s is the selector, the time limit or the reason
    "js_rendering_unavailable": ("No browser is available to render pages", False),
    "js_wait_timeout": ("Selector '%s' not found within timeout", True),
    "js_navigation_timeout": ("Browser navigation timed out after %sms", True),
    "js_rendering_failed": ("Browser rendering failed: %s", True),
    "js_empty_document": ("Browser returned an empty document", True),
}
EMPTY_DOCUMENT_CHARS = 50

# ---------------------------------------------------------------- fixed values: content errors
PAYWALL = (
    r"(?i)subscribe to (?:read|continue)|sign in to read|members only|"
    r"create an account to|premium content|\bpaywall\b"
)
BOT_WALL = (
    r"(?i)access denied|verify you are human|captcha|cloudflare|"
    r"unusual traffic|blocked|forbidden"
)
SUBSTANTIAL_MARKDOWN = 200
CONTENT_ERRORS = {  # code: (message, recoverable)
    "empty_page": ("Page appears empty or has no extractable content", False),
    "paywall": ("Content may be behind a paywall or login wall", False),
    "bot_detection": ("Target may be blocking automated access", True),
}

# ---------------------------------------------------------------- fixed values: corpus checks
ACTION_NAME_PATTERNS = [
    ("search_products", r"(?i)search|query"),
    ("go_to_next_page", r"(?i)\bnext\b|pagination|page[-/ ]?2"),
    ("search_quotes", r"(?i)search|quote"),
    ("submit_contact_form", r"(?i)submit|contact|custname"),
    ("accept_cookies", r"(?i)accept.*cook"),
    ("reject_cookies", r"(?i)reject.*cook"),
    ("manage_preferences", r"(?i)manage.*pref|cookie.*pref"),
]

CHECK_MESSAGES = {  # in check order
    "error": "unexpected error: %s — %s",
    "min_tokens": "markdown tokens %s < min %s",
    "must_contain": "markdown missing substring: %s",
    "must_not_contain": "markdown must not contain: %s",
    "code_fence": "markdown missing code fence",
    "path": "extraction_path %s != expected %s",
    "min_count": "actions count %s < min %s",
    "max_count": "actions count %s > max %s",
    "must_include": "missing action: %s",
    "must_not_include": "unexpected action present: %s",
    "local_effect": "no action with local/DOM effect found",
}
SKIPPED_REASON = "e2e multi-step flow not run in dashboard batch"

# ---------------------------------------------------------------- fixed values: contracts
DESTRUCTIVE_NAME = r"(?i)buy|purchase|pay|delete|confirm|submit order"
SENSITIVE_PATH = r"(?i)checkout|payment|order|delete"
PRICE = r"[$€£]\s?\d"
PROBES_PER_PAGE = 20
PROBE_COST_MS = 4000
PROBE_BUDGET_MS = 30000
HOP_HEADERS = ["host", "content-length"]
STATIC_ASSET = r"(?i)\.(js|css|png|jpg|jpeg|gif|svg|ico|woff2?|ttf|otf)(\?|$)"
ANALYTICS_HOST = r"(?i)google-analytics|googletagmanager|segment|doubleclick"
BEACON_MAX_BYTES = 200
CONTRACT_VERSION = "1"

# Query parameters that only track where a visitor came from (our own list).
TRACKING_PARAMETER = r"(?i)^(utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref)(=|$)"
