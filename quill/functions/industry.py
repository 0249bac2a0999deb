"""Vocabularies of the policy analysis: industry rules, action words and keywords."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    code: str
    title: str
    section: str
    keywords: tuple[str, ...]
    relation: str
    level: str


# Results depend on these words, labels and orders.
RULES = [
    Rule("ai", "人工智能应用", "downstream", ("人工智能", "AI", "智能", "大模型", "算法", "算力"), "直接相关", "强证据"),
    Rule("data", "数据要素与数据服务", "midstream", ("数据", "数据要素", "公共数据", "数据资源", "数据产品", "数据流通"), "直接相关", "强证据"),
    Rule("energy", "能源与绿色低碳", "support", ("能源", "电力", "绿色", "低碳", "碳", "能效", "清洁能源"), "直接相关", "强证据"),
    Rule("manufacturing", "工业制造与装备", "downstream", ("工业", "制造", "装备", "工厂", "中小企业", "产业链"), "间接相关", "间接证据"),
    Rule("infrastructure", "数字基础设施", "upstream", ("基础设施", "平台", "网络", "系统", "算力设施", "服务平台"), "潜在受益", "间接证据"),
    Rule("security", "安全合规与治理", "support", ("安全", "监管", "合规", "标准", "风险", "审查", "治理"), "约束风险", "强证据"),
    Rule("semiconductor", "半导体与关键元器件", "upstream", ("半导体", "芯片", "集成电路", "关键元器件", "EDA", "晶圆", "先进封装", "材料"), "潜在受益", "间接证据"),
    Rule("robotics", "机器人与智能装备", "midstream", ("机器人", "自动化", "智能装备", "数控", "工控", "无人装备", "工业母机"), "间接相关", "间接证据"),
    Rule("biomedicine", "生物医药与医疗健康", "downstream", ("医药", "生物医药", "医疗", "医疗器械", "医院", "公共卫生", "健康", "药品"), "直接相关", "强证据"),
    Rule("finance", "金融科技与数字金融", "support", ("金融", "支付", "征信", "风控", "普惠金融", "保险", "银行", "资本市场"), "约束风险", "间接证据"),
    Rule("transport", "交通物流与供应链", "downstream", ("交通", "物流", "仓储", "供应链", "冷链", "港口", "铁路", "公路", "航空"), "间接相关", "间接证据"),
    Rule("agriculture", "农业与乡村产业", "downstream", ("农业", "种业", "农机", "粮食", "乡村振兴", "农产品", "耕地", "智慧农业"), "直接相关", "强证据"),
    Rule("education", "教育科技与人才培养", "support", ("教育", "培训", "职业教育", "人才", "高校", "课程", "技能", "产教融合"), "间接相关", "间接证据"),
]
SECTIONS = ("upstream", "midstream", "downstream", "support")
ACTIONS = ("支持", "鼓励", "推动", "推进", "加快", "加强", "建立", "完善", "规范", "引导", "促进", "培育", "建设", "实施", "开展", "提升", "优化", "强化", "落实", "禁止", "不得", "严格", "严禁", "审查", "监管")
CONSTRAINT = ("禁止", "不得", "严禁", "严格", "监管", "审查", "规范", "合规", "风险")
SUPPORT = ("支持", "鼓励", "促进", "培育", "加快", "推动", "推进", "建设", "提升", "优化")
IMPLEMENTATION = ("建立", "完善", "实施", "开展", "落实", "加强", "强化", "引导")
RISK = "风险|处罚|问责|负面清单|红线"
KEYWORDS = (
    "人工智能", "大模型", "算力", "算法", "数据", "数据要素", "公共数据", "能源", "电力", "安全", "监管", "合规", "标准", "平台", "基础设施", "产业", "产业链", "企业", "创新", "绿色",
    "低碳", "制造", "装备", "半导体", "芯片", "集成电路", "机器人", "自动化", "医疗", "医药", "金融", "物流", "供应链", "农业", "教育", "人才", "数字化", "智能化", "中小企业", "服务",
)
INDUSTRIAL = ("产业", "产业链", "企业", "制造", "数据", "人工智能")
NUMBERED = "[0-9０-９]+%?|第[一二三四五六七八九十]+条|专栏|工程|行动"
LEADING = r"^[（(]?[一二三四五六七八九十\d]+[）).、\s-]*"
CLAUSE_NO = r"第[一二三四五六七八九十百\d]+条|[一二三四五六七八九十]+、|\d+[.)、]"
CATEGORIES = (("条例|规定|办法", "法规规章"), ("通知", "通知"), ("意见", "意见"), ("公告", "公告"))
PROVINCES = "北京市|天津市|上海市|重庆市|河北省|山西省|辽宁省|吉林省|黑龙江省|江苏省|浙江省|安徽省|福建省|江西省|山东省|河南省|湖北省|湖南省|广东省|海南省|四川省|贵州省|云南省|陕西省|甘肃省|青海省|台湾省|内蒙古自治区|广西壮族自治区|西藏自治区|宁夏回族自治区|新疆维吾尔自治区|香港特别行政区|澳门特别行政区"
NATIONAL = "国务院|中共中央|全国|国家|中国政府网|国家发展改革委|国家数据局|工业和信息化部|部委"
THEMES = (
    ("water", ("水利|水资源|南水北调|供水|水价|节水|再生水",)),
    ("vehicle", ("汽车|新能源车|智能网联|车联网|动力电池|充电",)),
    ("industrial-internet", ("工业互联网|智能制造|新型工业化|工业软件|工业模型|制造业数字化",)),
    ("ai-energy", ("人工智能|AI|大模型|算力|数据中心", "能源|电力|电网|新能源|虚拟电厂|绿色算力")),
    ("data", ("数据|数据要素|公共数据|数据资源|数据交易|数字经济|数据安全|数据资产",)),
    ("security", ("安全|个人信息|隐私|网络安全|合规|治理",)),
    ("industry", ("制造|工业|中小企业|专精特新|产业链|供应链",)),
)
# End of fixed values.
