"""Word lists, markers and patterns the results depend on.

These are data, not logic.  Every operator that reads one of them takes it as
a parameter, so a user can pass another list.
"""

# --- Fixed values: technology markers, in scan order. ------------------------
FINGERPRINTS: dict[str, list[str]] = {
    "Shopify": ["cdn.shopify.com", "myshopify.com", "shopify.theme", "shopify-section",
                "/cdn/shop/", "x-shopify-stage", "x-shopid", "x-shardid", "shopify-features",
                "window.shopify"],
    "Salesforce Commerce": ["demandware", "dwstatic", "/on/demandware.store/", "/dw/image/",
                            "dwac_", "x-dw-", "salesforce commerce", "sfcc",
                            "demandware.edgesuite.net", "/dw/shop/", "dwfrm_"],
    "BigCommerce": ["bigcommerce.com", "stencilbootstrap", "x-bc-", "mybigcommerce.com",
                    "cdn11.bigcommerce.com", "bigcommerce-labs"],
    "WooCommerce": ["woocommerce", "wc-blocks", "wc_add_to_cart",
                    "wp-content/plugins/woocommerce", "woocommerce-page", "wc-ajax"],
    "Magento": ["mage.cookies", "/skin/frontend/", "mage/cookies", "magento", "/static/version",
                "mage-translation", "x-magento-", "/pub/static/", "magento_", "mage-init"],
    "Salla": ["salla.sa", "cdn.salla.network", "salla-"],
    "Zid": ["zid.store", "cdn.zid.sa"],
    "PrestaShop": ["prestashop", "/img/p/", "presta-", "id_product"],
    "Ecwid": ["ecwid", "app.ecwid.com"],
    "Squarespace Commerce": ["squarespace-commerce"],
    "WordPress": ["wp-content", "wp-includes", "wp-json", "/wp-admin",
                  'name="generator" content="wordpress', "wp-block-", "wp-emoji"],
    "Wix": ["static.wixstatic.com", "wix-code", "wixsite.com", "x-wix-", "_wixcss",
            "x-wix-request-id", "wixstatic", "wix.com", "_wixapps"],
    "Squarespace": ["squarespace.com", "static1.squarespace.com", "static.squarespace.com",
                    "squarespace_context", "sqs-block", "squarespace-cdn", "this.squarespace"],
    "Webflow": ["webflow.com", "data-wf-page", ".webflow.io", "webflow.js", "wf-page", "w-mod-"],
    "GoHighLevel": ["msgsndr.com", "gohighlevel", "hl-builder", "leadconnectorhq.com",
                    "highlevelpages.com"],
    "Drupal": ["drupal.settings", "/sites/default/files", "x-generator: drupal",
               'content="drupal', "drupal-", "/core/misc/drupal"],
    "Joomla": ["/components/com_", "joomla!", "joomla.javascript", "/media/jui/", "option=com_"],
    "Ghost": ["ghost.io", "/ghost/", 'content="ghost', "ghost-sdk", "casper"],
    "Framer": ["framer.com", "framerusercontent.com", "data-framer-", "framer-"],
    "Duda": ["dudaone.com", "multiscreensite.com", "d_ssr", "irp.cdn-website.com"],
    "Weebly": ["weebly.com", "weeblycloud", "weebly-footer", "editmysite.com"],
    "ClickFunnels": ["clickfunnels.com", "etison.com", "cfgenerator", "myclickfunnels"],
    "Kajabi": ["kajabi.com", "kajabi-cdn", "kajabi-storefronts"],
    "Cargo": ["cargocollective.com", "cargo.site"],
    "HubSpot": ["hs-scripts.com", "hubspot", "hsforms.com", "hs-sites.com",
                "hubspotusercontent"],
    "Shopline": ["shoplineapp.com", "shopline"],
    "Next.js": ["__next_data__", "_next/static", "/_next/data/", "next/dist", "__next"],
    "Nuxt.js": ["__nuxt__", "/_nuxt/", "nuxt-link", "data-nuxt", "window.__nuxt", "nuxt.js",
                "_nuxt/entry"],
    "Vue.js": ["vue.js", "data-v-", "data-server-rendered", "__vue__", "vue-router"],
    "React": ["react-dom", "data-reactroot", "_reactrootcontainer", "__reactcontainer",
              "react.production.min"],
    "Angular": ["ng-version", "angular.js", "ng-app", "_nghost", "_ngcontent"],
    "Gatsby": ["___gatsby", "gatsby-", "/page-data/"],
    "Svelte": ["svelte-", "__svelte"],
}
IMPLIES = {"WooCommerce": "WordPress"}
FRAMEWORKS = ["Next.js", "Nuxt.js", "Vue.js", "React", "Angular", "Gatsby", "Svelte"]
SPA_MARKERS = ["__NEXT_DATA__", "_next/static", "/_nuxt/", "data-reactroot", "react-dom",
               'id="root"></div>', "id='root'></div>", "data-server-rendered",
               "data-react-helmet", "_app-"]

# --- Fixed values: link cleaning. --------------------------------------------
TRACKING_PREFIX = "utm_"
TRACKING_NAMES = ["gclid", "fbclid", "mc_eid", "mc_cid", "ref", "ref_src", "igshid"]
NOISE_HOSTS = [
    "google.", "bing.", "duckduckgo.", "duck.com", "ask.com", "yandex.",
    "baidu.", "naver.", "search.yahoo.", "ecosia.", "startpage.",
    "maps.google.", "photos.google.", "books.google.", "scholar.google.",
    "translate.google.", "support.google.", "policies.google.", "accounts.google.",
    "play.google.", "store.google.", "g.co", "goo.gl", "youtu.be",
    "youtube.", "facebook.", "fb.com", "fb.me", "instagram.", "instagr.am",
    "pinterest.", "pin.it", "reddit.", "redd.it", "tiktok.",
    "twitter.", "x.com", "t.co", "linkedin.", "lnkd.in",
    "snapchat.", "threads.net", "tumblr.", "vimeo.", "twitch.",
    "whatsapp.", "wa.me", "telegram.", "t.me", "discord.",
    "yelp.", "yellowpages.", "tripadvisor.", "trustpilot.", "bbb.org",
    "glassdoor.", "indeed.", "manta.com", "foursquare.",
    "justdial.", "sulekha.", "indiamart.", "tradeindia.",
    "amazon.", "ebay.", "etsy.com", "alibaba.", "aliexpress.",
    "walmart.", "target.com", "flipkart.", "myntra.", "ajio.",
    "wikipedia.", "wiktionary.", "medium.com", "quora.", "blogspot.",
    "wordpress.com", "stackoverflow.", "github.", "gitlab.",
    "apps.apple.", "microsoft.com", "apple.com/maps",
    "imgur.", "flickr.", "500px.", "behance.", "dribbble.",
    "drive.google.", "docs.google.", "sites.google.",
    "dropbox.", "onedrive.", "sharepoint.", "icloud.",
    "web.archive.org", "archive.org",
]
FILE_EXTENSIONS = [
    "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "csv", "zip", "rar", "7z", "tar", "gz",
    "jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "ico",
    "mp3", "mp4", "mov", "avi", "webm", "m4a", "wav", "exe", "dmg", "apk", "msi", "iso",
    "json", "xml", "rss", "atom", "txt",
]
PATH_FRAGMENTS = ["/maps/", "/maps?", "/search?", "/imgres?", "/imghp", "/url?", "/sorry/",
                  "/preferences", "/policies/", "/intl/", "/gws_rd", "/setprefs"]
EXCLUDED_TLD_LABELS = ["gov", "edu", "mil", "ac", "org", "nic"]
LOCAL_PREFIXES = ["127.", "0.0.0.0", "localhost", "192.168.", "10."]

# --- Fixed values: result pages. ---------------------------------------------
ENGINE_ORDER = ["google", "bing", "ddg"]
INTERSTITIAL_PATTERN = (
    r"/sorry/|unusual traffic|I'm not a robot|recaptcha|select all images|select images"
    r"|verify you are human|429 Too Many Requests|Rate limit exceeded"
)
NO_RESULTS_PATTERN = (
    r"did not match any documents|No results found|your search.*did not match"
    r"|did not match any"
)

# --- Fixed values: query expansion. ------------------------------------------
VERTICALS = ["Jewelry", "Fashion", "Retail"]
STACK_HINTS: dict[str, list[str]] = {
    "Shopify": ["site:myshopify.com", '"powered by shopify"', "inurl:/products/",
                "inurl:/collections/"],
    "WordPress": ['"powered by wordpress"', "inurl:wp-content", "inurl:/?p="],
    "WooCommerce": ['"powered by woocommerce"', '"proudly powered by woocommerce"',
                    "inurl:/product/"],
    "Wix": ["site:wixsite.com", '"site created with wix"'],
    "Squarespace": ["site:squarespace.com", '"powered by squarespace"'],
    "Webflow": ["site:webflow.io", '"made in webflow"'],
    "GoHighLevel": ["site:msgsndr.com", "site:leadconnectorhq.com", '"powered by gohighlevel"'],
    "BigCommerce": ["site:mybigcommerce.com", '"powered by bigcommerce"'],
    "Magento": ['"powered by magento"'],
    "Ghost": ['"powered by ghost"'],
    "ClickFunnels": ['"powered by clickfunnels"'],
    "Kajabi": ['"powered by kajabi"'],
    "Framer": ["site:framer.website"],
}
SEED_STACK = ("Shopify", "site:myshopify.com")
PLACE_PHRASES = ["based in", "made in", "ships from"]
OR_QUERY_EXCLUSIONS = [
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com",
    "tiktok.com", "wikipedia.org", "reddit.com", "pinterest.com", "quora.com", "medium.com",
    "amazon.com", "amazon.in", "flipkart.com", "myntra.com", "ajio.com", "meesho.com",
    "etsy.com", "ebay.com", "justdial.com", "sulekha.com", "indiamart.com", "tradeindia.com",
    "tripadvisor.com", "yelp.com", "trustpilot.com", "bbb.org",
]
OR_QUERY_NUDGES = ["(intitle:shop OR intitle:store OR intitle:brand)",
                   '("shop now" OR "add to cart" OR "buy now")', '"contact us"']

# --- Fixed values: contact extraction. ---------------------------------------
SOCIAL_PATTERNS: dict[str, str] = {
    "instagram": r"https?://(?:www\.)?instagram\.com/([A-Za-z0-9_.]{2,30})/?",
    "facebook": r"https?://(?:www\.|m\.)?facebook\.com/([A-Za-z0-9.\-]{3,60})/?",
    "twitter": r"https?://(?:www\.)?(?:twitter|x)\.com/([A-Za-z0-9_]{2,30})/?",
    "linkedin": r"https?://(?:www\.)?linkedin\.com/(?:company|in)/([A-Za-z0-9\-_.]+)/?",
    "youtube": r"https?://(?:www\.)?youtube\.com/(?:c/|channel/|user/|@)([A-Za-z0-9_\-]+)/?",
    "tiktok": r"https?://(?:www\.)?tiktok\.com/@([A-Za-z0-9_.]+)/?",
    "whatsapp": r"https?://(?:wa\.me|api\.whatsapp\.com/send)\??(?:phone=)?([+\d\s\-]{6,20})",
    "pinterest": r"https?://(?:www\.)?pinterest\.[a-z.]+/([A-Za-z0-9_\-]+)/?",
}
SOCIAL_STOPWORDS = ["sharer", "share", "intent", "tr", "p", "pin", "create", "developers"]
EMAIL_JUNK = ["wixpress", "sentry", "@2x.", "@3x.", "example.com", "domain.com", "yourcompany",
              "your-email", "noreply@", "no-reply@", "donotreply@", "u003e", "u003c",
              ".png", ".jpg", ".svg", ".webp"]
EMAIL_ASSET_SUFFIXES = ["png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js"]
PHONE_PATTERN = (
    r"(?:(?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{2,4}\)?[\s.\-]?)?"
    r"\d{3,4}[\s.\-]?\d{3,4}(?:[\s.\-]?\d{2,4})?)"
)
PHONE_CONTEXT = ["phone", "call", "tel", "mobile", "whatsapp", "contact", "reach us",
                 "customer care"]
FOOTER_HINTS = ["footer", "site-info", "site-bottom", "page-footer", "contact-info"]
CONTACT_PATHS = ["/contact", "/contact-us", "/contacts", "/pages/contact", "/pages/contact-us",
                 "/about", "/about-us", "/pages/about", "/imprint", "/impressum", "/legal"]
CONTACT_LINK_WORDS = ["contact", "about", "impressum", "imprint", "legal", "team",
                      "get in touch"]

# --- Fixed values: labelling. ------------------------------------------------
HINT_TLDS = ["com", "net", "co", "org", "io", "shop", "store", "app", "au", "uk", "in", "us",
             "ca", "nz", "me", "biz", "info"]
TRANSIENT_TOKENS = ["429", "timeout", "rate", "5", "connect", "network"]
EMPTY_RESPONSE = "model returned empty response"
UNREADABLE_RESPONSE = "could not parse JSON · raw: "
LEXICON: dict[str, list[str]] = {
    "Jewelry": ["jewelry", "rings", "necklaces", "watches", "gems"],
    "Fashion": ["fashion", "apparel", "shoes", "accessories"],
    "Retail": ["retail", "store", "shop", "goods"],
}

# --- Fixed values: exports. --------------------------------------------------
OUTREACH_NETWORKS = ["instagram", "facebook", "twitter", "linkedin", "youtube", "tiktok",
                     "whatsapp", "pinterest"]

# --- Fixed values: named character references that are decoded in text. ------
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©",
    "reg": "®", "trade": "™", "middot": "·", "bull": "•",
    "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘",
    "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«",
    "raquo": "»", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢",
    "deg": "°", "times": "×", "eacute": "é", "egrave": "è",
    "agrave": "à", "ccedil": "ç", "auml": "ä", "ouml": "ö",
    "uuml": "ü", "szlig": "ß", "ntilde": "ñ", "amp": "&",
}
