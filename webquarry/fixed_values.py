"""Lists, thresholds and patterns that results depend on."""

# Hosts that are never crawled, with their subdomains.
BLOCKED_HOSTS = (
    "wikipedia.org", "reddit.com", "youtube.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com",
    "google.com", "chatgpt.com", "gemini.google.com", "grokipedia.com", "quora.com", "investopedia.com", "britannica.com",
    "medium.com", "forbes.com", "crunchbase.com", "bloomberg.com", "techcrunch.com", "netguru.com", "munich-startup.de",
    "blockchain.com", "learn.bybit.com",
)
# Parts of URL paths and what they add to a crawl score.
HIGH_MARKERS = ("/contact", "/contacts", "/contact-us", "/kontakt", "/impressum", "/reach-us")
MEDIUM_MARKERS = ("/about", "/about-us", "/team", "/our-team", "/leadership", "/company", "/who-we-are")
LOW_MARKERS = ("/blog", "/news", "/press", "/article", "/post/", "/tag/", "/category/", "/stories/")
SKIPPED_ENDINGS = (".pdf", ".zip", ".doc", ".docx", ".xls", ".xlsx", ".mp4", ".jpg", ".jpeg", ".png", ".gif")
ARTICLE_MARKERS = ("/news/", "/article", "/press", "/blog/", "/post/", ".html", ".htm")
# Link priorities, first match wins.
LINK_PRIORITIES = (
    (10, ("/contact", "/contacts", "/contact-us")),
    (9, ("/about", "/about-us", "/company")),
    (8, ("/team", "/our-team", "/leadership")),
    (6, ("/impressum", "/legal", "/privacy")),
    (4, ("/services", "/products", "/solutions")),
    (2, ("/blog", "/news", "/articles")),
)
CONTACT_PAGE_PARTS = ("/contact", "/contacts", "/about", "/team", "/leadership", "/impressum", "/legal", "/who-we-are", "/our-team")
INTERNAL_LINK_ENDINGS = (".pdf", ".jpg", ".png", ".zip", ".mp4", ".doc")
PRIMARY_PATHS = ("/contact", "/contacts", "/contact-us", "/impressum", "/kontakt")
CONTACT_PATHS = ("/contact", "/contacts", "/about", "/about-us", "/team", "/our-team", "/leadership", "/contact-us", "/impressum", "/legal")
EXTRA_PATHS = ("/team-members", "/our-story", "/company", "/leadership-team")
SITEMAP_SKIPPED = (".jpg", ".png", ".pdf", ".zip", ".mp4")
# E-mail addresses that are no business contacts.
BLOCKED_MAILBOXES = ("noreply", "no-reply", "donotreply", "support", "admin", "webmaster", "postmaster")
FREE_PROVIDERS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "mail.ru", "yandex.ru")
RESERVED_TOPS = ("arpa", "invalid", "local", "localhost", "onion", "test")
# Patterns of contacts.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MAILTO = r"""(?i)href=["']mailto:([^"']+)["']"""
TELEGRAM = r"(?:https?://)?(?:t\.me|telegram\.me)/([a-zA-Z0-9_]+)"
TELEGRAM_NAME = r"(?i)(?:Telegram|TG|Телеграм)[:\s]*@([a-zA-Z0-9_]{5,})"
TELEGRAM_INVITE = r"join\.chat/([A-Za-z0-9_-]+)"
TELEGRAM_HREF = r"""(?i)href=["']([^"']*t\.me[^"']*)["']"""
LINKEDIN = r"(?:https?://)?(?:www\.)?linkedin\.com/((?:in|company)/[a-zA-Z0-9_-]+)"
LINKEDIN_NAME = r"(?i)LinkedIn[:\s]*(?:https?://)?(?:www\.)?linkedin\.com/((?:in|company)/[a-zA-Z0-9_-]+)"
LINKEDIN_HREF = r"""(?i)href=["']([^"']*linkedin\.com/(?:in|company)/[^"']+)["']"""
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
SOCIAL = {
    "x": r"(?i)(?:https?://)?(?:www\.)?(?:x\.com|twitter\.com)/[A-Za-z0-9_]{1,50}",
    "facebook": r"(?i)(?:https?://)?(?:www\.)?facebook\.com/[A-Za-z0-9_.-]{1,100}",
    "instagram": r"(?i)(?:https?://)?(?:www\.)?instagram\.com/[A-Za-z0-9_.]{1,50}",
    "youtube": r"(?i)(?:https?://)?(?:www\.)?youtube\.com/(?:@|c/|channel/|user/)[A-Za-z0-9_.-]{1,100}",
}
OBFUSCATION = r"(?i)\[at\]|\(at\)| at |\[dot\]|\(dot\)| dot |\{@\}"
# Words that say nothing about a company's field.
GENERIC_TAGS = ("b2b", "company", "business", "website")
# Limits and thresholds.
PAYLOAD_PAGES, PAYLOAD_TEXT, PAYLOAD_HTML = 3, 15000, 50000
ERROR_STATUS, MIN_HTML, MIN_TEXT = 400, 80, 200
LOCK_SECONDS = 300
KEYWORDS_A_RUN = 50
HINT_RUNNING, HINT_FAILED = 15, 20
ALERT_ZERO_PAGES, ALERT_TIMEOUT_RATE, ALERT_CONTACTS_RATE, ALERT_AVERAGE = 5, 35.0, 20.0, 0.5
DENYLIST_DAYS, DENYLIST_ZERO_CRAWLS, DENYLIST_LIMIT = 7, 3, 25
MAX_RETRIES = {"search_keyword": 3, "crawl_domain": 2, "extract_contacts": 1, "save_results": 3}
CONTACT_TYPES = ("email", "telegram", "linkedin", "phone", "x", "facebook", "instagram", "youtube")
KEYWORD_SYNONYMS = {
    "стартап": ("компания", "бизнес", "предприятие"),
    "startup": ("company", "business", "venture"),
    "финтех": ("financial technology", "fintech"),
}
