"""Default routing and risk pack for Chinese fire-safety questions.

Fixed values: word lists that routing and risk results depend on.  The scene and
graph lexicons are parameters; load them with ``packs.loader``.
"""

from __future__ import annotations

from clausegraph.packs.base import RiskPack, RoutePack

PUNISH_WORDS = ["处罚", "罚款", "拘留", "后果", "违法", "责任", "怎么办", "怎么罚", "处理", "惩罚"]

ROUTE = RoutePack(
    refuse_words=["你多大", "你女朋友", "作弊", "帮我犯罪", "赚钱方法"],
    refuse_unless="消防",
    off_topic=["电影", "电视剧", "综艺", "游戏", "音乐", "明星", "八卦", "笑话", "段子", "天气", "旅游", "美食", "菜谱", "股票", "基金",
               "恋爱", "相亲", "星座", "运势", "足球", "篮球", "世界杯"],
    domain=["消防", "法规", "规定", "违反", "条款", "火灾", "疏散", "安全出口", "消火栓", "灭火器", "电动车", "电动自行车", "高层住宅",
            "高层建筑", "物业", "防火", "动火", "消防控制室", "消控室", "应急预案", "火警", "通道", "楼道", "堆放", "杂物", "消防车",
            "着火点", "逃生", "高层", "民用建筑", "公共建筑", "建筑", "违规", "电焊", "气焊", "明火", "装修", "施工", "演练", "巡查",
            "检查记录", "职责", "灭火", "报警", "烟感", "探测器", "灭火系统", "喷淋", "验收", "避难层", "防火间距", "消防技术服务", "维保",
            "消防安全评估", "消防设计审查", "消防验收", "值班", "持证", "上岗", "无证", "没证"],
    law_priority=["隐患", "整改", "规定", "条款", "违反", "违法", "处罚", "罚款", "职责", "责任", "监督检查", "演练", "培训", "着火点",
                  "怎么罚", "负什么责", "有什么要求", "如何整改", "应当怎么", "应当做", "追究", "谁负责", "责任在谁", "可以不报警"],
    law_scene=["广告牌", "挡住", "堆放", "占用", "堵塞", "障碍"],
    law_scene_anchor="火灾",
    strong_emergency=["着火了", "起火了", "冒烟", "烟很大", "全是烟", "浓烟", "烧起来", "火很大", "火势很大", "火要烧过来", "被困", "困住了",
                      "救命", "出不去", "爆炸声", "火情", "烧着", "快烧到", "火势"],
    weak_emergency=["着火", "起火"],
    neutral_replace=("着火点", "【点火位置】"),
    alarm_words=["火灾", "119", "报警"],
    alarm_context=["怎么办", "现在", "现场", "家里", "楼里", "发生", "逃生", "救命", "怎么处理"],
    duty_topics=["演练", "培训", "应急预案", "疏散演练", "防火检查", "巡查", "值班"],
    duty_lacks=["不组织", "从不", "没组织", "未组织", "没有组织", "没搞", "没开展", "没举行", "没做过", "不搞", "不做", "没有做", "从来没"],
    immediate=["现在", "正在", "马上", "已经烧", "已经着", "快烧", "火要"],
    punish_words=PUNISH_WORDS,
    chat=["你好", "您好", "谢谢", "你是谁", "介绍一下", "能做什么", "再见", "hello", "hi ", "在吗", "加油"],
    domain_unless="闲聊",
)

RISK = RiskPack(
    high_behaviors=["占用疏散通道", "占用消防车通道", "埋压圈占消火栓", "损坏挪用消防设施", "电动自行车违规停放充电", "违规明火作业",
                    "违规储存危险品", "占用避难层", "设置障碍物影响逃生", "违规使用燃气", "高风险作业指使"],
    reasons={
        "占用疏散通道": "疏散通道受阻", "占用消防车通道": "占用消防车通道", "埋压圈占消火栓": "消火栓被埋压圈占",
        "损坏挪用消防设施": "消防设施损坏停用", "电动自行车违规停放充电": "电动自行车违规充电", "违规明火作业": "违规动火作业",
        "违规储存危险品": "违规储存易燃易爆品", "占用避难层": "避难层被占用", "设置障碍物影响逃生": "门窗设障碍影响逃生",
        "违规使用燃气": "违规使用燃气", "高风险作业指使": "违章指挥冒险作业", "占用电缆井管道井": "电缆井/管道井堆物",
        "占用防火间距": "占用防火间距", "谎报火警": "谎报火警", "无人值班": "消防控制室无人值班", "值班人员不足": "消防控制室值班不足",
        "未保持完好有效": "消防设施未保持完好有效", "未组织防火检查": "未开展防火检查", "未组织消防演练": "未组织消防演练",
        "未开展消防培训": "未开展消防培训",
    },
    venues=["人员密集场所", "高层民用建筑", "高层住宅建筑", "高层公共建筑"],
    venue_reason="涉及人员密集/高层场所",
    emergency_reason="疑似正在发生火情/险情",
    penalty_reason="处罚咨询：主体/场景不明时结论分歧大",
)

FOLLOW_UP_MARKERS = ["那", "那么", "这个", "这种", "上述", "还会", "具体", "罚多少", "多少钱", "怎么处理", "举报", "哪个部门", "向谁",
                     "会怎么样", "没证", "无证", "值班会"]
FOREIGN_NAMES = ["网络安全法", "数据安全法", "个人信息保护法", "密码法", "民法典", "刑法", "劳动法", "劳动合同法", "公司法", "道路交通安全法",
                 "食品安全法", "环境保护法", "广告法", "消费者权益保护法", "电子商务法", "证券法", "著作权法"]
OUTSIDE_TOPICS = ["报考", "技能鉴定", "考试科目", "职业资格", "CCC", "认证目录", "森林火灾", "报废年限", "报废标准", "国家标准是多少年",
                  "灭火器的报废"]
