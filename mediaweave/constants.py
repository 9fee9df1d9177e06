"""Word lists, patterns and limits the results depend on.

Everything in this file is data. The operators say how it is used.
"""

# --- file extensions (fixed values) ---
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".tiff", ".bmp", ".avif", ".ico"]
VIDEO_EXTENSIONS = [
    ".mp4", ".webm", ".ogg", ".mov", ".avi", ".wmv", ".flv", ".mkv",
    ".m4v", ".ts", ".mpeg", ".mpg",
]
AUDIO_EXTENSIONS = [".mp3", ".wav", ".aac", ".flac", ".ogg", ".opus", ".m4a"]
STREAM_EXTENSIONS = [".mpd", ".m3u8"]
DOCUMENT_EXTENSIONS = [".pdf"]
TRASH_EXTENSIONS = [".gif", ".ico", ".svg", ".cur"]
WEBPAGE_EXTENSIONS = [
    ".html", ".htm", ".php", ".asp", ".aspx", ".jsp", ".jspx",
    ".cfm", ".cfml", ".py", ".rb", ".pl", ".cgi", ".shtml", ".xhtml",
]
SCRIPT_EXTENSIONS = [
    ".js", ".jsx", ".ts", ".tsx", ".coffee", ".es6", ".mjs",
    ".css", ".scss", ".sass", ".less",
    ".json", ".xml", ".rss", ".atom", ".yaml", ".yml",
    ".wasm", ".map",
]
NOT_A_PAGE_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".bmp", ".avif",
    ".mp4", ".webm", ".ogg", ".mov", ".mp3", ".wav", ".pdf",
]
VIDEO_URL_EXTENSIONS = [
    ".mp4", ".webm", ".ogg", ".mov", ".avi", ".wmv", ".flv", ".mkv", ".m4v", ".ts", ".m3u8", ".mpd",
    ".3gp", ".vob", ".mxf", ".f4v", ".mpg", ".mpeg", ".asf", ".rm", ".rmvb",
]
DIRECT_VIDEO_EXTENSIONS = [".mp4", ".webm", ".avi", ".mov", ".flv", ".mkv", ".wmv", ".ts"]
SKIP_CRAWL_EXTENSIONS = [".css", ".js", ".map", ".xml", ".json", ".txt", ".ico", ".woff", ".woff2", ".ttf"]
NOT_DOWNLOADABLE_EXTENSIONS = [".html", ".htm", ".php", ".asp", ".aspx", ".js", ".css", ".json", ".xml"]
SCORED_MEDIA_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".mp4", ".webm", ".avi"]

# --- words inside URLs (fixed values) ---
FULLSIZE_WORDS = ["full", "large", "original", "highres", "hires", "hi-res", "max", "big"]
FULLSIZE_PAGE_WORDS = ["full", "large", "original", "highres", "hires", "hi-res", "big"]
FULLSIZE_SCORE_WORDS = ["full", "large", "original", "highres", "hires", "hi-res", "max", "big", "best"]
FULLSIZE_LINK_WORDS = ["full", "large", "original"]
FULLSIZE_PATH_HINTS = ["/full/", "/large/", "/original/", "fullsize", "highres"]
VIDEO_PLATFORM_INDICATORS = [
    "youtube.com", "youtu.be", "youtube-nocookie.com",
    "vimeo.com", "player.vimeo.com",
    "dailymotion.com", "dai.ly",
    "twitch.tv",
    "streamable.com",
    "redgifs.com", "gifdeliverynetwork.com",
    "gfycat.com",
    "bilibili.com", "b23.tv",
    "tiktok.com",
]
CDN_MEDIA_HOSTS = [
    "cloudfront.net", "akamaihd.net", "googleapis.com", "cloudflare.com",
    "cdninstagram.com", "twimg.com", "imgur.com", "staticflickr.com",
    "ytimg.com", "fbcdn.net", "ssl-images-amazon.com", "pinimg.com",
    "wp.com", "media-amazon.com", "media.tumblr.com",
]
MEDIA_PATHS = [
    "/images/", "/img/", "/photos/", "/photo/", "/pictures/", "/pics/",
    "/thumbnails/", "/thumb/", "/avatars/", "/uploads/", "/media/",
    "/static/", "/assets/", "/files/", "/download/", "/gallery/",
    "/videos/", "/video/", "/movie/", "/movies/", "/clip/", "/clips/",
]
MEDIA_PARAMS = [
    "image", "img", "photo", "pic", "video", "media", "file", "download",
    "media_url", "source", "src", "thumb", "preview", "original",
]
VIDEO_HOSTS = [
    "vimeo.com", "youtube.com", "youtu.be", "dailymotion.com", "twitch.tv",
    "streamable.com", "vimeocdn.com", "jwplatform.com", "brightcove.net",
    "vidyard.com", "wistia.com", "jwplayer.com", "bitchute.com",
    "vk.com/video", "facebook.com/watch", "redgifs.com", "gfycat.com",
]
VIDEO_PATHS = [
    "/playlist.m3u8", "/manifest.mpd", "/master.m3u8",
    "/hls/", "/dash/", "/streaming/", "/video/",
    "/media/", "/player/", "/videos/", "/embed/",
    "/get_video", "/download/video", "/v/",
]
VIDEO_PARAMS = ["video_id", "vid", "v", "video", "clip", "file"]
CONTENT_WORDS = [
    "view", "show", "gallery", "album", "photo", "image", "pic", "media", "full",
    "display", "post", "entry", "article", "story", "video", "watch", "page", "item",
    "content", "viewer", "collection", "detail", "preview", "original", "fullsize", "large",
]
CONTENT_SECTIONS = ["post", "article", "blog", "entry", "content", "page", "story", "news"]
NAV_WORDS = [
    "index", "home", "main", "contact", "about", "login", "signup",
    "register", "search", "categories", "tags", "menu",
]
HOME_PATHS = [
    "", "/", "/index.html", "/index.php", "/home", "/main",
    "/index", "/default.aspx", "/default.html", "/home.html",
]
PATTERN_WORDS = [
    "gallery", "photo", "image", "media", "video", "upload", "pictures", "album",
    "content", "original", "fullsize", "full-size", "highres", "hi-res", "hires",
    "large", "pic", "img", "view", "post", "viewer", "preview", "reel",
]
SKIP_SEGMENTS = [
    "login", "signin", "signup", "register", "logout", "account", "profile",
    "cart", "checkout", "payment", "subscribe", "billing", "password", "auth",
    "privacy", "privacy-policy", "terms", "tos", "legal", "copyright",
    "dmca", "cookies", "cookie-policy", "gdpr", "imprint", "impressum",
    "about", "about-us", "contact", "careers", "jobs", "press", "help",
    "support", "faq", "feedback", "sitemap", "robots.txt",
    "advert", "advertising", "ads", "adserver", "sponsor", "promo",
    "newsletter", "unsubscribe", "widget", "embed", "share", "redirect",
    "go", "out", "external", "tracking", "pixel", "analytics",
    "search", "login.php", "wp-admin", "wp-login",
]
STOP_WORDS = [
    "login", "register", "cart", "checkout", "about_us", "contact",
    "privacy_policy", "terms_of_service", "careers",
]
AD_HOSTS = [
    "doubleclick.", "googlesyndication.", "googleadservices.",
    "facebook.com/tr", "adservice.", "adnxs.", "taboola.", "outbrain.",
]
AD_WORDS = [
    "ads", "advert", "advertisement",
    "banner", "promo", "promotion", "sponsor",
    "tracking", "pixel", "analytics", "marketing", "campaign",
    "popup", "popover", "cta", "calltoaction", "call-to-action",
]
NOISE_WORDS = [
    "favicon", "sprite", "emoji", "gravatar", "userpic",
    "/logo.", "/icon/", "/icons/", "apple-touch-icon",
    "pixel.", "1x1.", "tracking", "analytics",
    "facebook.com", "twitter.com", "t.co/",
    "icon", "avatar", "social-", "button-", "placeholder", "nav-",
    "banner-", "advert", "ad-", "tracker",
    "instagram", "linkedin", "youtube", "telegram", "vk.com", "yandex",
]

# --- URL patterns (fixed values) ---
CMS_PATTERNS = [
    r"/post/", r"/article/", r"/page/", r"/entry/", r"/view/",
    r"/gallery/", r"/album/", r"/photo/", r"/collection/",
    r"/\d+\.\d+\.\d+/", r"/category/", r"/tag/",
    r"\?id=", r"&id=", r"\?page=", r"&page=",
    r"view\.php", r"index\.php", r"gallery\.php",
]
VIDEO_NAME_PATTERNS = [
    r"/video[_-]\d+", r"/clip[_-]\d+", r"/movie[_-]\d+",
    r"/media_[a-f0-9]{32}", r"/player_[a-f0-9]{8}",
    r"/play\.php\?vid=", r"/watch\?v=",
]
CDN_PATTERNS = {
    "img": [
        r"\.cloudfront\.net", r"\.akamaized\.net", r"\.cloudinary\.com", r"\.fastly\.net", r"\.imgix\.net",
        r"\.cdn\.", r"images?[0-9]*\.", r"cdn[0-9]*\.", r"static\.", r"media\.",
    ],
    "video": [
        r"\.brightcove\.net", r"\.jwplatform\.com", r"\.vimeocdn\.com", r"\.ytimg\.com",
        r"\.streamable\.com", r"video\.", r"videos?\.", r"media\.",
    ],
}
# Patterns holding a path are matched against the host alone and so never hit.
VIDEO_PLATFORMS = {
    "youtube": [r"youtube\.com", r"youtu\.be", r"youtube-nocookie\.com"],
    "vimeo": [r"vimeo\.com", r"player\.vimeo\.com", r"vimeocdn\.com"],
    "dailymotion": [r"dailymotion\.com", r"dai\.ly", r"dm-static\.com"],
    "twitch": [r"twitch\.tv", r"ttvnw\.net", r"jtvnw\.net"],
    "facebook": [r"facebook\.com/watch", r"facebook\.com/video", r"fbcdn\.net", r"fb\.watch"],
    "instagram": [r"instagram\.com/tv", r"instagram\.com/reel", r"instagram\.com/p", r"cdninstagram\.com"],
    "tiktok": [r"tiktok\.com", r"musical\.ly", r"tiktokcdn\.com"],
    "vk": [r"vk\.com/video", r"vk\.ru/video"],
    "reddit": [r"reddit\.com/r/.*/video/", r"v\.redd\.it"],
    "twitter": [r"twitter\.com/.*/status/", r"t\.co", r"twimg\.com", r"pbs\.twimg\.com"],
    "redgifs": [r"redgifs\.com", r"gifdeliverynetwork\.com"],
    "bilibili": [r"bilibili\.com", r"bilivideo\.com", r"b23\.tv"],
    "streamable": [r"streamable\.com"],
    "imgur": [r"imgur\.com/a", r"imgur\.com/gallery", r"imgur\.com/\w+\.gifv", r"imgur\.com/\w+\.mp4"],
    "gfycat": [r"gfycat\.com"],
    "soundcloud": [r"soundcloud\.com"],
    "xvideos": [r"xvideos\.com"],
    "xhamster": [r"xhamster\.com"],
    "pornhub": [r"pornhub\.com"],
    "youporn": [r"youporn\.com"],
}
BROWSER_JUNK_PATTERNS = [
    r"/l-stat\.", r"/userpic", r"/avatar", r"/logo\.",
    r"/favicon", r"/emoji", r"/gravatar", r"/icon[s]?/",
    r"ljcounter", r"/blank\.", r"/spacer\.", r"/pixel\.",
    r"1x1\.", r"/spinner", r"/loading", r"\.svg$",
    r"/button[s]?/", r"/badge", r"/arrow",
    r"/(nav|menu|search|cart|share|social|widget|advert|tracker)\b",
    r"/(prev|next|close|expand|collapse|play|pause|mute|volume)\b",
    r"\.(gif|png|ico)$",
]
JS_REDIRECT_PATTERNS = [
    r"""window\.location(?:\.href)?\s*=\s*["']([^"']+)["']""",
    r"""window\.location\.replace\s*\(\s*["']([^"']+)["']\s*\)""",
    r"""document\.location(?:\.href)?\s*=\s*["']([^"']+)["']""",
    r"""<meta[^>]*?http-equiv=["']?refresh["']?[^>]*?content=["']?\d+;\s*url=([^\s"'>]+)["']?""",
]
SCRIPT_MEDIA_PATTERNS = {
    "image_sources": [
        r"""["'](https?://[^"']+\.(?:jpg|jpeg|png|gif|webp))["']""",
        r"""\.src\s*=\s*["'](https?://[^"']+)["']""",
        r"""loadImage\s*\(\s*["'](https?://[^"']+)["']""",
        r"""background(?:-image)?\s*:\s*url\(["']?(https?://[^"')]+)["']?\)""",
    ],
    "video_sources": [
        r"""["'](https?://[^"']+\.(?:mp4|webm|ogg))["']""",
        r"""\.src\s*=\s*["'](https?://[^"']+\.(?:mp4|webm|ogg))["']""",
        r"""loadVideo\s*\(\s*["'](https?://[^"']+)["']""",
    ],
    "data_attributes": [
        r"""data-(?:src|original|lazy|load|image|video|poster|bg|background|url)\s*=\s*["'](https?://[^"']+)["']""",
        r"""data-srcset\s*=\s*["'](https?://[^"']+(?:\s+\d+[wx])?(?:,\s*https?://[^"']+(?:\s+\d+[wx])?)*)["']""",
    ],
}

# --- page markup (fixed values) ---
HIDDEN_STYLES = [
    "display: none", "display:none", "visibility: hidden", "visibility:hidden",
    "opacity: 0", "opacity:0", "left: -999", "top: -999", "width: 0", "height: 0",
]
HIDDEN_CLASSES = ["hidden", "sr-only", "visually-hidden", "bot-trap", "honeypot", "invisible", "d-none"]
IMAGE_ATTRIBUTES = [
    "src", "data-src", "data-original", "data-lazy", "data-lazy-src", "data-original-src",
    "data-hi-res-src", "data-high-res", "data-hires", "data-retina", "data-full",
    "data-fullsize", "data-fullsizeurl", "data-max-res", "data-maxres",
]
SRCSET_ATTRIBUTES = ["srcset", "data-srcset", "data-lazy-srcset"]
HIRES_ATTRIBUTE_WORDS = ["hi-res", "high", "retina", "full", "original", "max"]
LAZY_ATTRIBUTES = [
    "data-src", "data-original", "data-lazy", "data-load", "data-source",
    "data-srcset", "data-bg", "data-poster", "data-image", "data-original-src",
]
GATEWAY_TEXTS = [
    "i agree", "agree", "confirm", "continue", "yes", "i am 18", "enter", "accept",
    "i am over 18", "enter site", "verify", "continue to", "i confirm", "agree and enter",
    "enter the site", "yes, enter", "yes, i am",
    "согласен", "подтверждаю", "да", "да, мне есть 18", "старше 18", "старше 18 лет",
    "продолжить", "войти", "принимаю", "войти на сайт", "да, я старше 18 лет",
    "подтверждаю возраст", "принимаю условия",
]
GATEWAY_OVERLAY_WORDS = [
    "confirm your age", "18 years old", "adult content", "войти", "подтвердите", "18 лет",
    "proceed", "leave", "enter", "over 18", "agree", "confirm", "i agree",
]
GATEWAY_ATTRIBUTE_WORDS = ["agree", "confirm", "enter", "over18", "accept", "continue", "verify", "18"]
GATEWAY_LEGAL_WORDS = [
    "legal", "terms", "tos", "policy", "agreement", "rules", "copyright", "privacy", "help", "about",
]
JSONLD_VIDEO_KEYS = ["contentUrl", "embedUrl", "url"]
# images of a list that the reference reads; the queries read all
JSONLD_LISTED = 5
MEDIA_KEY_WORDS = [
    "url", "src", "source", "media", "image", "img", "photo", "picture",
    "thumbnail", "thumb", "icon", "avatar", "video", "file", "path",
    "href", "link", "content", "data", "original", "high_res", "hd",
]
PAGING_KEYS = ["next", "next_page", "nextPage", "pagination", "paging", "links"]
FULLSIZE_SOURCES = ["sieve-res", "link-direct"]

# --- fetching (fixed values) ---
NOT_MEDIA_CONTENT_TYPES = [
    "text/html", "application/javascript", "text/javascript", "text/css", "application/json",
]
CONTENT_SKIP_REASONS = [
    "file too small", "already exists", "invalid extension", "unsupported",
    "webpage/script content", "trash media",
]

# --- limits and defaults (fixed values) ---
MIN_IMAGE_WIDTH = 100
MIN_IMAGE_HEIGHT = 100
MIN_SIGNIFICANT_SIDE = 100
HIGH_QUALITY_SIDE = 800
MIN_IMAGE_KB = 40
MIN_VIDEO_KB = 1000
SEARCH_DEPTH = 3
MAX_LINKS_PER_PAGE = 200
MAX_LINKED_PAGES = 50
MAX_JS_REDIRECTS = 5
IDLE_SECONDS = 5.0
QUARANTINE_FAILURES = 3
QUARANTINE_BATCH = 10
QUARANTINE_RETRIES = 1
HOST_CONCURRENCY = 2
TIMEOUT_SECONDS = 30
RETRY_COUNT = 3
PROBATION_TIMEOUT_SECONDS = 5
PROBATION_RETRIES = 0
MAX_NAME_LENGTH = 200
MAX_EXTENSION_LENGTH = 7
MAX_DIR_PARTS = 2
MAX_DIR_PART_LENGTH = 50
NAME_HASH_LENGTH = 10
MIN_RANGE_BYTES = 256 * 1024
RANGE_WRITE_BYTES = 1024 * 1024
MAX_RANGES = 8
SETTING_RANGES = {
    "search_depth": (0, 10, 3),
    "page_limit": (1, 10000, 1),
    "page_timeout": (5, 600, 30),
    "timeout": (1, 600, 30),
    "retry_count": (0, 20, 3),
    "parser_threads": (1, 64, 4),
    "downloader_threads": (1, 128, 8),
    "threads_per_file": (1, 8, 1),
    "min_image_width": (0, 99999, 100),
    "min_image_height": (0, 99999, 100),
    "min_image_size": (0, 99999, 40),
    "min_video_size": (0, 99999, 1000),
    "max_download_speed": (0, 100000, 0),
}
HEADER_SETTINGS = ["user_agent", "accept_language"]
TERMINAL_STATUSES = ["completed", "stopped", "failed"]
CSV_COLUMNS = ["#", "ID", "URL", "Status", "Downloaded", "Found", "Created", "Started", "Completed", "Path"]
