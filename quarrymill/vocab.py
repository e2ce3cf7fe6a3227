"""Fixed values that results depend on. Plain lists in natural order; operators take them as parameters."""

# Tokens that stand for "no value" after trimming blanks.
NO_VALUE = ["", "N/A", "null", "nan", "未知", "无", "处理异常", "[待补全]"]

# Aliases of units in lower case, the base unit of their kind and the factor to it.
UNIT_ALIASES = {
    ("mW", "1"): ["mw", "milliwatt", "milliwatts", "毫瓦", "毫瓦特"],
    ("mW", "1000"): ["w", "watt", "watts", "瓦", "瓦特"],
    ("mW", "1000000"): ["kw", "kilowatt", "kilowatts", "千瓦", "千瓦特"],
    ("mW", "1000000000"): ["megawatt", "megawatts", "兆瓦", "兆瓦特"],
    ("um", "0.001"): ["nm", "nanometre", "nanometres", "nanometer", "nanometers", "纳米"],
    ("um", "1"): ["um", "μm", "µm", "micron", "microns", "micrometre", "micrometer", "micrometres", "micrometers", "微米"],
    ("um", "1000"): ["mm", "millimetre", "millimetres", "millimeter", "millimeters", "毫米"],
    ("um", "10000"): ["cm", "centimetre", "centimetres", "centimeter", "centimeters", "厘米", "公分"],
    ("um", "100000"): ["dm", "decimetre", "decimetres", "decimeter", "decimeters", "分米"],
    ("um", "1000000"): ["m", "metre", "metres", "meter", "meters", "米", "公尺"],
    ("um", "25400"): ["in", "in.", "inch", "inches", "英寸", "英吋", "吋", "″"],
    ("um", "304800"): ["ft", "ft.", "foot", "feet", "英尺", "′"],
    ("um", "914400"): ["yd", "yd.", "yard", "yards", "码"],
    ("um", "1000000000"): ["km", "kilometre", "kilometres", "kilometer", "kilometers", "千米", "公里"],
    ("mg", "0.001"): ["μg", "µg", "ug", "mcg", "microgram", "micrograms", "微克"],
    ("mg", "1"): ["mg", "milligram", "milligrams", "毫克"],
    ("mg", "1000"): ["g", "gr", "gm", "gram", "grams", "gramme", "grammes", "克", "公克"],
    ("mg", "1000000"): ["kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "千克", "公斤"],
    ("mg", "1000000000"): ["t", "tonne", "tonnes", "吨"],
    ("mg", "500000"): ["斤", "市斤"],
    ("mg", "50000"): ["两", "市两"],
    ("mg", "453592.37"): ["lb", "lbs", "lb.", "lbs.", "pound", "pounds", "磅"],
    ("mg", "28349.523125"): ["oz", "oz.", "ounce", "ounces", "盎司"],
    ("kHz", "0.001"): ["hz", "hertz", "赫", "赫兹"],
    ("kHz", "1"): ["khz", "kilohertz", "千赫", "千赫兹"],
    ("kHz", "1000"): ["mhz", "megahertz", "兆赫", "兆赫兹"],
    ("kHz", "1000000"): ["ghz", "gigahertz", "吉赫", "吉赫兹", "千兆赫"],
    ("kHz", "1000000000"): ["thz", "terahertz", "太赫", "太赫兹"],
}

# Order of the keyword classes of hazards; the first class with a keyword in the text wins.
HAZARD_CLASSES = [
    ("急性毒性", ["中毒", "有毒", "致命", "急性"]),
    ("皮肤刺激", ["皮肤", "灼伤", "刺激"]),
    ("眼部刺激", ["眼", "眼睛", "眼部"]),
    ("呼吸道刺激", ["呼吸", "吸入"]),
    ("致癌性", ["致癌", "癌"]),
    ("致突变性", ["致突变", "突变"]),
    ("生殖毒性", ["生殖", "胎儿"]),
]

# Classes of storage conditions.
STORAGE_CLASSES = [
    ("温度条件", ["温度", "°C", "℃", "低温", "冷藏"]),
    ("环境条件", ["通风", "干燥", "避光", "阴凉"]),
    ("容器要求", ["密闭", "容器", "储存"]),
    ("隔离要求", ["远离", "避免", "禁止", "分开"]),
]

# Solvents and grades of solubility; of each the first in this order that a sentence holds counts.
SOLVENTS = ["水", "乙醇", "乙醚", "苯", "氯仿", "丙酮", "酸", "碱"]
SOLUBILITY_GRADES = ["溶于", "不溶于", "微溶于", "易溶于", "难溶于", "混溶", "任意比例混溶"]

# Relation types by keyword; the default comes last.
RELATION_TYPES = [
    ("工艺", ["上游", "原料", "制备", "制造", "生产"]),
    ("化学反应", ["反应", "化合", "分解", "氧化", "还原"]),
    ("用途", ["用途", "应用", "制取"]),
    ("转化", ["转化", "变成", "得到"]),
]

# Classes of error messages in order of priority.
ERROR_CLASSES = [
    ("authentication", ["api_key", "authentication", "authorization", "unauthorized", "invalid_key", "access_denied", "credential", "token",
                        "认证", "授权", "密钥", "凭证", "令牌", "身份验证", "访问被拒绝"]),
    ("rate_limit", ["quota", "rate_limit", "limit_exceeded", "too_many_requests", "throttle", "requests_per_minute", "daily_limit",
                    "配额", "频率限制", "限制超出", "请求过多", "节流", "每分钟请求数", "日限制"]),
    ("network", ["timeout", "connection", "network", "dns", "unreachable", "socket", "ssl", "certificate", "handshake",
                 "超时", "连接", "网络", "域名解析", "无法访问", "套接字", "证书", "握手"]),
    ("request_error", ["bad_request", "400", "404", "not_found", "invalid_request", "malformed", "syntax_error", "invalid_json",
                       "错误请求", "未找到", "无效请求", "格式错误", "语法错误", "无效json"]),
    ("server_error", ["internal_server_error", "500", "502", "503", "504", "service_unavailable", "gateway_timeout", "bad_gateway",
                      "服务器内部错误", "服务不可用", "网关超时", "错误的网关"]),
    ("safety_policy", ["safety", "policy", "harmful", "blocked", "filtered", "violation", "restricted", "prohibited", "denied", "unsafe",
                       "dangerous", "content_filter", "harm_category", "inappropriate",
                       "安全", "政策", "有害", "阻止", "过滤", "违规", "限制", "禁止", "拒绝", "不安全", "危险", "内容过滤", "不当内容", "敏感内容"]),
]

# Measures in free text. Factors to kilopascal and to grams per cubic centimetre; units of solubility;
# marks of degrees; what stands between the ends of a range and before the temperature of a measurement.
PRESSURE_UNITS = {"kPa": 1.0, "Pa": 0.001, "hPa": 0.1, "MPa": 1000.0, "bar": 100.0, "atm": 101.325, "mmHg": 0.133322}
DENSITY_UNITS = {"g/cm³": 1.0, "g/ml": 1.0, "kg/m³": 0.001}
SOLUTE_UNITS = ["g", "mg"]
SOLVENT_UNITS = ["mL", "L", "g", "mg"]
DEGREES = ["℃", "°?[CKF]"]
RANGE_WORDS = ["-", "~", "to", "至"]
CONDITION_WORDS = ["at", "@", "在"]

# Groups of synonyms, the standard form first.
SYNONYMS = [
    ["固态", "固体", "固相"],
    ["液态", "液体", "液相"],
    ["气态", "气体", "气相"],
    ["密闭容器", "密闭储存", "密封存储"],
    ["避光", "避光保存", "遮光储存"],
    ["低温", "冷藏", "低温保存"],
    ["无色", "透明", "无色透明"],
    ["白色", "白色至浅黄色", "白色至浅棕色"],
    ["黄色", "浅黄色", "淡黄色"],
]

# Connectives that a name must not end with.
CONNECTIVES = ["为", "在", "和", "与", "主要", "包括", "以及", "及", "或", "等", "用", "作", "作为", "通过", "经过", "利用", "使用", "含", "含有",
               "属于", "来源于", "来自", "等物", "等品"]

# Filler words deleted from names, words that are no names, and marks of a substance's name.
NAME_FILLERS = ["包括", "等", "类", "中", "的", "和", "与", "及", "或", "各种", "多种", "主要", "广泛", "常见", "一般", "通常", "特别", "尤其", "特殊",
                "以及", "还有", "另外", "此外", "同时", "另", "其他", "部分", "如", "例如", "比如", "诸如", "像", "譬如", "好比", "如同", "等等",
                "之类", "左右", "上下", "约", "大约", "接近", "差不多", "括"]
NAME_STOP_WORDS = ["等", "类", "中", "上", "下", "前", "后", "左", "右", "内", "外", "高", "低",
                   "大", "小", "多", "少", "好", "坏", "新", "旧", "快", "慢", "热", "冷",
                   "工业", "农业", "医药", "食品", "化工", "石油", "煤炭", "天然气",
                   "生产", "制造", "加工", "处理", "使用", "应用", "方法", "技术", "工艺"]
NAME_INVALID_WORDS = ["等", "类", "中", "上", "下", "前", "后", "左", "右", "内", "外",
                      "高", "低", "大", "小", "多", "少", "好", "坏", "新", "旧", "快", "慢",
                      "热", "冷", "工业", "农业", "医药", "食品", "化工", "生产", "制造",
                      "加工", "处理", "使用", "应用", "方法", "技术", "工艺", "公司",
                      "企业", "有限", "股份", "集团", "反应", "制备", "合成", "包括",
                      "通过石油", "经过石油", "利用石油", "使用石油", "乙烯氢气", "通过"]
NAME_ALWAYS_VALID = ["苯", "甲苯", "二甲苯", "石油", "煤", "天然气", "水", "氨", "氢气", "氧气", "氮气"]
NAME_MARKS = ["酸", "碱", "盐", "醇", "醛", "酮", "酯", "醚", "烷", "烯", "炔", "苯", "酚", "腈", "甲", "乙", "丙", "丁", "戊", "己", "庚", "辛", "壬",
              "癸", "正", "异", "叔", "仲", "邻", "间", "对", "顺", "反", "氢", "氧", "氮", "氯", "硫", "钠", "钾", "钙", "镁", "铁", "铜", "锌",
              "铅", "汞", "银", "聚", "环", "二", "三", "四", "五", "六", "七", "八", "九", "十", "气", "油", "脂", "胶"]
GRADE_PREFIXES = ["化学纯", "分析纯", "AR", "CP", "GR"]

# Texts that count as no information, by use.
INVALID_FIELDS = ["N/A", "NULL", "NONE", "未知", "无数据", "无", "不详", "UNKNOWN", "NOT AVAILABLE", "NOT APPLICABLE", "NO DATA", "/", "-", "",
                  "待补充", "缺失", "MISSING", "TBD", "TO BE DETERMINED", "NA", "NAN", "空", "无效", "INVALID", "NO INFO", "NO INFORMATION"]
INVALID_ANSWERS = ["", "null", "none", "n/a", "na", "undefined", "[待补全]", "待补全", "暂无", "无", "未知", "...", "<具体值>", "<值>", "占位符",
                   "placeholder", "todo", "tbd"]

# Words cut from the start of a listed name, words from which on its rest is cut, and words of producer clauses.
LIST_PREFIXES = ["由", "从", "以", "通过", "经过", "利用", "使用", "主要", "含有", "含"]
LIST_SUFFIXES = ["等", "类", "制得", "制备", "制成", "生产", "合成", "反应", "裂解", "氧化", "分解", "化学品", "原料", "物质", "材料", "中提取", "为原料", "作为溶剂"]
PRODUCER_WORDS = ["主要生产商", "生产商", "生厂商", "制造商", "生产企业", "制造企业"]
ORGANISATION_WORDS = ["公司", "企业", "厂", "集团"]

# Phrases that state what a substance is made from, in order; the group is the list of materials. Beside each what a
# text must hold for it, so that a phrase is looked for only where it can be. Lists may hold 、.
MATERIAL_PATTERNS = [
    ("上游原料[：:]?\\s*包括\\s*([^。；;]+)", "上游原料"),
    ("原料(?:包括)?[：:]\\s*([^。；;]+)", "原料(?:包括)?[：:]"),
    ("以\\s*([^为]+?)\\s*为原料", "为原料"),
    ("由\\s*([^制]+?)\\s*(?:制得|制成|制备)", "制得|制成|制备"),
    ("从\\s*([^中]+?)\\s*中(?:提取|分离|得到)", "中(?:提取|分离|得到)"),
    ("([^。；;，,]+?)\\s*(?:裂解|氧化|分解)(?:得到|制得|产生)", "(?:裂解|氧化|分解)(?:得到|制得|产生)"),
    ("原料.*?包括\\s*([^。；;]+)", "原料.*?包括"),
    ("主要原料[：:]?\\s*([^。；;]+)", "主要原料"),
    ("所需原料[：:]?\\s*([^。；;]+)", "所需原料"),
    ("以\\s*([^。；;，,]*)\\s*(?:等\\s*)?(?:化学品|原料|物质)", "化学品|原料|物质"),
    ("使用\\s*([^。；;，,]*)\\s*(?:等\\s*)?(?:作为|为)\\s*原料", "(?:作为|为)\\s*原料"),
    ("从\\s*([^。；;，,]*)\\s*(?:等\\s*)?中", "从"),
]
# What is cut from either end of a material, and characters of actions, which no new material may have.
MATERIAL_PREFIXES = ["通过", "经过", "利用", "使用", "主要", "从", "由"]
MATERIAL_SUFFIXES = ["等", "类", "反应", "制得", "制备", "制成", "裂解", "氧化", "分解", "化学品", "原料", "物质"]
ACTION_CHARACTERS = "制得备成反应裂解氧化分"
# Units known in free text.
TEXT_UNITS = ["°C|℃|K|°F", "Pa|kPa|MPa|bar|atm|mmHg", "g/mol|Da|u", "g/cm³|kg/m³|g/mL", "mol/L|M|ppm|ppb|%"]

# Columns of a record and their headers in a graph import; the kind after the colon tells how a value is made.
NODE_COLUMNS = {
    "中文名称": "name:ID",
    "CAS号或流水号": "cas:id",
    "中文别名": "aliases:string[]",
    "英文名称": "english_name:name",
    "英文别名": "english_aliases:string[]",
    "分子式": "molecular_formula:string",
    "分子量": "molecular_weight:string",
    "危害": "hazard:string",
    "防范": "prevention:string",
    "危害处置": "hazard_disposal:string",
    "用途": "uses:string",
    "自然来源": "natural_source:string",
    "生产来源": "production_source:producers",
    "上游原料": "upstream_materials:string",
    "性质": "properties:string",
    "data_source": "source:source",
    "浓度阈值": "concentration_threshold:string",
}
HAZARD_COLUMNS = ["危害", "防范", "危害处置", "浓度阈值"]

# Relation types of the graph.
PRODUCES, COMES_FROM, TAKES_PART, RAW_MATERIAL = "产生", "来源", "参与", "原料"
PLACEHOLDER = "[待补全]"
SOURCE_DEFAULT = "根据通义大模型蒸馏而来"
