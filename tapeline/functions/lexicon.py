"""Fixed values of the news rules: sources, keyword lists, weights and aliases.

All of them are defaults; every operator takes its own tables.
"""

# Provider -> (source, kind, reliability, language, market, priority).
SOURCES = {
    "EastmoneyAnnouncementProvider": ("交易所公告聚合", "official_announcement", 0.92, "zh-CN", "A股", 1),
    "CoinDeskProvider": ("CoinDesk", "financial_media", 0.78, "en", "加密货币", 2),
    "CointelegraphProvider": ("Cointelegraph", "financial_media", 0.68, "en", "加密货币", 2),
    "CNBCMarketsProvider": ("CNBC Markets", "financial_media", 0.82, "en", "美股", 2),
    "BBCBusinessProvider": ("BBC Business", "financial_media", 0.84, "en", "全球", 2),
    "YahooFinanceProvider": ("Yahoo Finance", "aggregator", 0.70, "en", "美股", 2),
}

# Event kinds in matching order, each with its keywords.
EVENT_RULES = {
    "Earnings": ("财报", "业绩", "earnings", "revenue", "profit"),
    "Guidance": ("指引", "guidance", "outlook"),
    "Product": ("新品", "发布产品", "new product", "launches"),
    "M&A": ("收购", "并购", "merger", "acquisition"),
    "Regulation": ("监管", "sec ", "regulation", "antitrust"),
    "Government Policy": ("政策", "法案", "government policy", "tariff"),
    "Interest Rate": ("美联储", "降息", "加息", "interest rate", "fed "),
    "Inflation": ("cpi", "通胀", "inflation"),
    "Employment": ("非农", "失业率", "employment", "payroll"),
    "Geopolitics": ("战争", "冲突", "制裁", "war", "sanction"),
    "Legal": ("诉讼", "法院", "lawsuit", "court"),
    "Supply Chain": ("供应链", "短缺", "supply chain", "shortage"),
    "Management": ("董事长", "高管", "ceo", "management"),
    "Capital Flow": ("资金流", "净流入", "capital flow", "inflow", "outflow"),
    "ETF": ("etf",),
    "Listing": ("上市", "listing"),
    "Delisting": ("退市", "delisting"),
    "Token Unlock": ("代币解锁", "token unlock", "unlock"),
    "Protocol Upgrade": ("协议升级", "硬分叉", "protocol upgrade", "hard fork"),
    "Hack": ("黑客", "被盗", "hack", "exploit"),
    "Security Incident": ("安全事件", "security incident", "breach"),
    "Partnership": ("合作", "partnership"),
    "Funding": ("融资", "funding", "financing"),
    "Whale Activity": ("巨鲸", "whale transfer", "whale activity"),
    "ETF Flow": ("etf flow", "etf inflow", "etf outflow"),
    "Exchange Listing": ("交易所上线", "exchange listing"),
    "Exchange Delisting": ("交易所下架", "exchange delisting"),
    "On-chain Activity": ("链上", "on-chain", "onchain"),
    "Stablecoin Event": ("稳定币", "stablecoin"),
}

# Event kinds to which markets react most.
SENSITIVE = ("Regulation", "Interest Rate", "Inflation", "Geopolitics", "Hack", "Security Incident", "Token Unlock")

# Direction words and their weights.
WEIGHTS = {
    "大增": 32, "超预期": 30, "获批": 28, "回购": 23, "增持": 20, "重大合同": 23, "突破": 18, "增长": 14, "上涨": 12, "降息": 16,
    "创新高": 18, "改善": 12, "利好": 18, "beats": 28, "surge": 22, "rally": 16, "approval": 20, "record high": 18,
    "暴跌": -35, "处罚": -30, "调查": -25, "违约": -35, "爆雷": -38, "亏损": -22, "减持": -18, "下调": -16, "下跌": -12, "加息": -16,
    "限制": -20, "风险": -12, "召回": -22, "misses": -28, "plunge": -30, "lawsuit": -22, "ban": -25,
}

# Sector keywords.
SECTORS = {
    "半导体": ("芯片", "半导体", "semiconductor", "gpu", "晶圆"),
    "AI算力": ("人工智能", " ai ", "artificial intelligence", "算力", "服务器", "data center"),
    "新能源": ("锂电", "电池", "光伏", "风电", "electric vehicle"),
    "消费": ("白酒", "消费", "零售"),
    "金融": ("银行", "券商", "保险", "利率", "bank"),
    "数字资产": ("比特币", "btc", "bitcoin", "以太坊", "eth", "ethereum", "solana", "加密", "crypto"),
    "黄金": ("黄金", "gold"),
    "原油": ("原油", "oil", "opec"),
}

# Names under which an instrument is mentioned.
ALIASES = {
    "600519": ("600519", "贵州茅台", "茅台"), "000001": ("000001", "平安银行"), "300750": ("300750", "宁德时代"),
    "002594": ("002594", "比亚迪"), "000858": ("000858", "五粮液"), "NVDA": ("nvda", "nvidia", "英伟达"),
    "AMD": ("amd", "advanced micro devices", "超威"), "TSLA": ("tsla", "tesla", "特斯拉"), "AAPL": ("aapl", "apple", "苹果公司"),
    "MSFT": ("msft", "microsoft", "微软"), "GOOGL": ("googl", "google", "alphabet", "谷歌"), "BTC": ("btc", "bitcoin", "比特币"),
    "ETH": ("eth", "ethereum", "以太坊"), "SOL": ("sol", "solana"), "BNB": ("bnb", "binance coin"),
}
