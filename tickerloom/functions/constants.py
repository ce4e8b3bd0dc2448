"""Thresholds, weights, word lists and patterns that results depend on."""

# Component maxima of the 0-100 score and evidence curve parameters.
EVIDENCE_MAX = 45.0
GRAPH_MAX = 20.0
EXPOSURE_MAX = 15.0
MARKET_MAX = 20.0
KEYWORD_CAP = 1.5
DIVERSITY_MIN = 0.2
DIVERSITY_STEP = 1.5
DIVERSITY_MAX = 5.0
RELATION_CAP, RELATION_MAX = 2.0, 12.0
WEAK_CAP, WEAK_MAX = 1.0, 8.0
WEAK_NODE_BONUS, WEAK_EDGE_BONUS = 0.5, 0.25
BREADTH_FLOOR = 0.08

# Fixed values: (half life, window) in days per decay profile.
DECAY_PROFILES = {"short_news": (2, 7), "industry_cycle": (10, 30), "fundamental_theme": (30, 90)}

# Weights of the seven market components.
MARKET_WEIGHTS = {"momentum5": 6.0, "momentum20": 5.0, "volume": 4.0, "breakout": 3.0, "compression": 2.0,
                  "fibonacci": 0.0, "support": 0.0}
FIB_LEVELS = (0.382, 0.5, 0.618)

# Nine theme buckets, first match wins.
THEME_BUCKETS = (
    ("半导体", "(半导体|芯片|集成电路|分立器件|电子化学品)"),
    ("航运交通", "(航运|港口|交通运输|运输)"),
    ("国防军工", "(军工|航空装备|航天装备|航海装备|导弹|护卫舰)"),
    ("算力通信", "(算力|计算机设备|通信设备|通信网络|软件开发|大模型|数据中心)"),
    ("家电消费", "(家电|电器|电烤箱|烘焙|厨卫|小家电)"),
    ("化工材料", "(氟化工|玻纤|玻璃|化肥|农化|复合肥|氮肥|钾肥|磷肥)"),
    ("食品农业", "(乳品|饮料乳品|食品|白酒|养殖|饲料|肉制品)"),
    ("机器人设备", "(机器人|自动化设备|专用设备|通用设备)"),
    ("资源能源", "(钢铁|铁矿|能源|石油|油气|燃气|煤炭)"),
)

# Business-variable words; the prefilter adds commodity and sector words.
BUSINESS_WORDS = (
    "需求|订单|销量|销售|消费|装机|采购|交付|出口|中标|库存|产量|产能|供应|供给|不足|下降|减少|紧张|短缺|瓶颈|受限|"
    "价格|报价|现货|期货|上涨|涨价|大涨|突破|新高|资金|成交|融资|增持|回购|政策|补贴|支持|推进|促进|审批|准入|许可"
)
PREFILTER_WORDS = BUSINESS_WORDS + (
    "|白银|黄金|铜|铝|锂|镍|稀土|煤炭|石油|天然气|电力|光伏|新能源|储能|电池|芯片|半导体|机器人|算力|医药|创新药|化工|航运|航空|军工"
)
STOCK_NAME_PATTERN = (
    r"(?:^|[^\x{4E00}-\x{9FA5}])(?:ST|[*＊]ST|[\x{4E00}-\x{9FA5}]{2,6}"
    r"(?:股份|科技|集团|银行|证券|有色|能源|药业|医药|电子|化工|电力|汽车|材料))(?:$|[^\x{4E00}-\x{9FA5}])"
)

# Site suffixes cut from reprinted titles.
SITE_SUFFIX_PATTERN = (
    r"[-_—–|｜:：·\s]+((新浪|腾讯|网易|搜狐|凤凰|东方财富|同花顺|雪球|财联社|第一财经|证券时报|上海证券报|中国证券报|"
    r"证券日报|每日经济新闻|界面|澎湃)(网|版|端|频道|专区|\.com|\.cn)?(财经|证券)?|财经|证券|股票|基金|期货|外汇|理财|股吧|"
    r"论坛|博客|视频|直播|评论(网|版)?)$"
)

# Punctuation dropped from keywords, and trailing numerals.
KEYWORD_PUNCTUATION = r"[()（）【】\[\]《》\"“”、,，.。:：;；/\\|-]"
KEYWORD_NUMERALS = r"[ⅡⅢ]$"

# Near-duplicate thresholds and follower weight.
TITLE_SIMILARITY, CONTENT_SIMILARITY, FOLLOWER_WEIGHT = 0.60, 0.85, 0.15

# Selection gates.
MAX_GAIN_5D, MAX_LOSS_5D, MAX_LOSS_20D, MAX_PRICE, MAX_DAY_DROP = 0.2, -0.10, -0.15, 40.0, -0.03

# Surge channel.
SURGE_MIN_GAIN, SURGE_MIN_RATIO, SURGE_BASE, SURGE_CAP, SURGE_TOP = 0.095, 1.2, 55.0, 95.0, 24

# Trust rank of a fact by source and taxonomy level.
SOURCE_RANKS = {"akshare_industry_board_em": 75, "akshare_concept_board_em": 65, "akshare_individual_info_em": 55}
TAXONOMY_RANKS = {"SW3": 100, "SW2": 90, "SW1": 80}
UNIVERSE_SOURCE = "tickflow_sw_universe"
MANUAL_SOURCES = ("manual_verified", "test_exposure")
EXCLUDED_SOURCE, EXCLUDED_TYPE = "historical_limitup_news", "movement_evidence"
