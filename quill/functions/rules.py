"""Rule vocabularies: which words count as which signal."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    code: str
    label: str
    weight: int
    pattern: str


# Codes, labels, weights and patterns that results depend on.
EXCLUSIONS = [
    Rule("interpretation", "政策解读、图解或答记者问", 0, "政策解读|一图读懂|图解|专家解读|答记者问|新闻发布会|访谈实录|政策吹风会"),
    Rule("personnel", "人事任免或人员信息", 0, "人事任免|任免通知|任职通知|免职通知|关于.{0,20}同志任免|领导简历"),
    Rule("meeting_news", "会议或一般工作动态", 0, "召开.{0,18}会议|会议召开|工作动态|领导活动|调研活动|考察活动"),
    Rule("commendation", "表彰、通报表扬或荣誉信息", 0, "表彰|通报表扬|先进个人|先进集体|荣誉称号"),
    Rule("opinion_feedback", "征求意见反馈或意见采纳说明", 0, "征求意见.*反馈|意见采纳情况|意见征集结果|公开征求意见情况"),
]
STRONG = [
    Rule("price_tax", "价格、税费或收费机制", 5, "价格|水价|电价|气价|油价|关税|税率|减税|免税|退税|收费标准|收费管理"),
    Rule("subsidy_fund", "补贴、补助或专项资金", 5, "补贴|补助|奖励资金|专项资金|财政资金|贴息|政府投资基金|产业基金"),
    Rule("procurement", "采购、招标或首批次应用", 5, "政府采购|采购需求|招标|首台.?套|首批次|首版次|订购|采购目录"),
    Rule("access_regulation", "准入、许可、强制监管或处罚", 4, "市场准入|行业准入|准入条件|许可管理|行政许可|强制性|禁止|处罚|监管办法|安全审查|合规要求"),
    Rule("standard_requirement", "标准、规范或技术要求", 3, "国家标准|行业标准|强制性标准|技术标准|技术规范|技术要求|评价规范|认证规则"),
    Rule("list_catalog", "目录、清单、名单或认定结果", 3, "目录|清单|名单|认定|推荐目录|示范名单|试点名单"),
    Rule("project_pilot", "项目、试点或示范任务", 3, "重大项目|重点项目|项目清单|试点|示范工程|示范区|先行区|应用示范"),
    Rule("implementation_deadline", "明确实施日期或完成时限", 3, r"自\d{4}年\d{1,2}月\d{1,2}日起施行|自发布之日起施行|截至\d{4}年|\d{4}年\d{1,2}月底前|\d{4}年底前|限期完成"),
]
DIRECTIONS = [
    Rule("plan_measure", "规划、行动计划或实施措施", 3, "规划|行动计划|实施方案|实施意见|指导意见|若干措施|工作要点|专项行动|发展纲要"),
    Rule("industrial_action", "存在产业或市场行动要求", 2, "产业|企业|市场|投资|基础设施|供应链|产业链|数字化|智能化|绿色化|技术改造|创新应用|扩大内需|消费|制造业|能源|数据要素|人工智能"),
    Rule("action_verb", "包含支持、推动或建设等政策动作", 2, "支持|推动|加快|促进|建设|发展|完善|提升|改造|培育|鼓励|扩大|优化|实施"),
    Rule("formal_document", "正式政策文件", 1, "通知|意见|办法|规定|决定|公告|方案|细则|指南|指引|条例|规划"),
]
RETROSPECTIVE = "公布.{0,24}典型(?:应用)?案例(?:名单)?|典型(?:应用)?案例名单|优秀案例名单"
COMPETITION = "揭榜挂帅|征集|申报|遴选|试点|示范任务|招标|采购|首批次|首台.?套"
STANDARD_PLAN = "标准制修订项目计划|标准项目计划"
BROAD_PLAN = "(?:“|《)?十五五(?:”|》)?规划|综合规划|发展规划|建设规划"
SUBJECTS = "牵头单位|主要起草单位|入围.{0,12}单位|中标单位|供应商名单|申报单位|推荐单位"
LISTED, BODIES, DRAFTED, PRICED = "名单|目录|认定结果", "单位|企业|机构", "主要起草单位", "价格|税率|收费标准"
NO_SIGNAL = "正式政策，但暂未识别出需要优先深度分析的强动作"
TEXT_LIMIT, RAW_LIMIT, FORWARD_LIMIT, SUBSTANTIVE = 12000, 4000, 3000, 280
# End of fixed values.
MARKET = ("price_tax", "subsidy_fund", "procurement", "access_regulation")
