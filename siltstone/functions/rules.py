"""Vocabularies, patterns and thresholds that decide results. Data only."""

# URL canonicalisation.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src")
TRACKING_PREFIX = "utm_"
HOME_DOMAIN = "ustc.edu.cn"
UPLOADED_HTML_DIR = "/_upload/article/files/"
ASSET_EXTENSIONS = ("7z", "avi", "bmp", "caj", "csv", "doc", "docx", "dps", "epub", "et", "gif", "gz", "jpeg", "jpg", "key", "md", "mp3", "mp4", "numbers", "odp", "ods", "odt", "pages", "pdf", "png", "pps", "ppsx", "ppt", "pptx", "rar", "rtf", "svg", "tar", "tex", "tgz", "tif", "tiff", "txt", "webp", "wps", "xls", "xlsx", "xml", "zip")
#: First bytes of binary payloads, in hex.
BINARY_SIGNATURES = ("255044462D", "504B0304", "D0CF11E0A1B11AE1", "526172211A07", "377ABCAF271C", "89504E470D0A1A0A", "474946383761", "474946383961", "FFD8FF")
#: Why a URL isn't worth a request: reason, pattern of its path, pattern of its query (both in lower case).
LOW_VALUE = (
    ("logout endpoint", r"/logout(?:/|$)", None),
    ("search endpoint", r"/search(?:/|$)", None),
    ("search endpoint", None, r"[?]search="),
    ("sorted/paginated author listing variant", r"/author/detail/", r"(?:pageindex|pagesize|showtype|orderby)="),
    ("sorted/paginated duplicate variant", r"/(?:list|search|detail)", r"(?:orderby|showtype|pagesize)="),
    ("personal/statistics endpoint", r"gradebook|submission_history|/stats/|/statistics/", None),
    ("interactive login page", r"/webapps/login$|/(?:login|logon|signin|sign[-_]?in)(?:/|$)", None),
    ("duplicate Indico event variant", r"^(?=.*/event/).*(?:/event[.]ics$|/manage/|/author/)", None),
    ("duplicate Indico event variant", r"/event/", r"(?:print|view|showtimezone)="),
    ("duplicate Indico calendar variant", r"^(?=.*/category/).*/(?:calendar|closest|upcoming|previous|statistics|search)$", None),
    ("duplicate Indico calendar variant", r"^(?=.*/category/).*/overview", r"(?:date|period|detail)="),
    ("session-specific URL", None, r"(?:^|&)(?:jsessionid|sessionid|sid|token)(?:=|&|$)"),
)
DOWNLOAD_ENDINGS = ("/download", "/download/", "/download.jsp", "/download.aspx")
DOWNLOAD_KEYS = ("attachment", "fileid", "wbfileid", "urltype", "download")

# Signals of page value. Case-insensitive.
NEWS = r"(?:news|notice|announcement|press|bulletin|xwdt|tzgg|xwzx|xyxw|news_list|新闻|公告|通知|动态|要闻|公示|媒体|/(?:info|article|show_)(?:[/_.?-]|$)|/20[0-9]{2}/[0-9]{4}/c[0-9]+a[0-9]+/)"
RESOURCE = r"(?:assignment|homework|exercise|lab(?:work)?|exam|test|answer|solution|syllabus|lecture|course[-_ ]?material|作业|习题|实验|报告|答案|参考材料|试题|考试|讲义|课件|课程资源|优秀实验报告|作业区)"
AUTH = r"(?:login|logon|signin|sign[-_ ]?in|logout|password|用户名|密码|登录|认证|统一身份)"
NAVIGATION = r"(?:search|query|stats?|statistics|gradebook|submission|calendar|dashboard|notification|logout|登录|搜索|查询|统计|成绩|提交记录|日历|仪表盘)"
DOCUMENT = r"\.(?:pdf|docx?|pptx?|ppsx?|xlsx?|csv|odt|ods|odp|rtf|wps|et|dps|caj|epub|tex|txt|md|pages|numbers|key|mp4|webm|mov|mkv|avi|mp3|m4a|wav|ogg)(?:$|[?#])"
TIERS = ((70, "full_index"), (40, "metadata_and_assets"), (16, "audit_only"))
NOT_INDEXED = "not_indexed"
#: Paths of detail pages, in lower case.
DETAIL_PATHS = (r"/(?:info|article|show_|view|detail|content)(?:[/?_.-]|$)", r"/20[0-9]{2}/[0-9]{4}/c[0-9]+a[0-9]+/", r"/web/news/[0-9]+", r"/news_detail-[0-9]+", r"/newslists/news/", r"/class_[0-9]+/(?:news|post)/", r"/(?:notice|news)/(?:[^/]+/)?[0-9]+\.(?:html?|aspx)$")

# Where pages keep their content: a place (tag, #id, .class, [class*='part'], a space for "inside") and what it adds to the length of its text.
CONTENT_PLACES = (
    ("#Content", 2200), ("#divContent", 2200), (".media-foucs", 1800), (".detail-content", 1800), (".wp_articlecontent", 1800), ("#wp_articlecontent", 1800), ("#SubPage", 1500), ("#con_main", 1600), (".con_main", 1600),
    (".wl-detail", 1800), (".newsdetail_main", 1800), (".container_bg", 1600), (".central_text", 1900), (".newscont", 1800), (".inner-news-detail", 1800), (".wl-xueshu", 1900), (".cont .text", 1800), (".SubPage", 1500),
    (".news-detail-notes", 1900), (".articel-show-text", 1800), (".newscontent", 1700), (".newsNr", 1700), (".node__content", 1600), (".field--name-body", 1600), ("article", 950), ("main", 100), (".v_news_content", 2200),
    ("#vsb_content", 2200), (".article-content", 850), (".article_content", 850), (".article-body", 0), (".entry-content", 0), (".post-content", 800), (".page-content", 1800), (".confBodyBox", 1700), (".mainContent", 1600),
    (".conference-page", 1500), (".item-summary", 1500), (".contribution-description", 1900), (".contribution-content", 1900), (".paper-content", 1900), (".news_content", 0), (".news-content", 0), (".content", 0),
    (".InfoBox", 1800), (".infobox", 1800), (".detail", 0), (".article", 0), ("td.content", 500), ("td[class*='content']", 450), ("[class*='article']", 0), ("[class*='content']", 0),
)
#: A place that counts though it is hidden (scripts show it), and places that count even if empty.
HIDDEN_PLACE, EMPTY_PLACES = "#divContent", (".cont .text", ".InfoBox", ".infobox", ".newsNr")
#: From this boost on a place is trusted with little text.
SURE_BOOST, LEAST_TEXT = 1500, 40
#: Titles that say nothing, words of a page that is nothing but its frame, and paths of listings, attachments and events.
BANNERS = ("banner", "banner3", "banner信息")
FRAME_WORDS = r"(?:发布时间|阅读次数|浏览次数|上一篇|下一篇|上一条|下一条|来源|作者)\s*[:：]?"
FRAME_MARKS = r"[\s0-9|:/：.\-\ue000-\uf8ff]+"
LISTING_PATH, ATTACHMENT_PATH, EVENT_PATH = r"/(?:list|index)(?:[-_]?[0-9]+)?(?:/|\.[^/?]+)?$", "/attachment/", r"/event/[0-9]+/(?:page|contributions)/"

# Publication types.
NOTICE_URL_PARTS = ("/notice/", "/announcement/", "tzgg", "xxgg", "gonggao", "tongzhi")
NOTICE_SECTIONS = ("/info/1360/", "/info/1361/", "/info/1362/", "/info/1363/", "/info/1364/", "/info/1365/", "/info/1366/")
NOTICE_TREE = "wbtreeid=136"
CENTRAL_SOURCE = "university"
VIDEO_PATH = "/kecheng/video/"
OTHER_TITLES = ("faculty",)
OTHER_CATEGORIES = ("视频中心", "视频专访")
MATH_SOURCE = "unit-math-ustc-edu-cn"
MATH_CATEGORIES = ("fundamental mathematics", "computational mathematics", "probability theory and mathematical statistics", "applied mathematics", "mathematical physics")
NOTICE_CATEGORY_WORDS = ("通知", "公告", "公示")
NOTICE_TITLE_WORDS = ("公告", "公示")
REPORTAGE_WORDS = ("新闻", "报道")
ADMISSION_WORDS = ("安排", "简章", "名单", "方案", "通告", "导师", "研究方向")
RETEST_WORDS = ("办法", "流程", "规定", "录取")
OTHER_KINDS = ("course_resource", "document", "asset", "unknown")
PUBLIC_KINDS = ("news_article", "article")
