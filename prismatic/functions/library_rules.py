"""The rules by which a library's tags are held against what a picture shows: concepts with their names, and rules of tags. As data, for operators.tag_rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TagRule:
    """A tag's dimension, the fields that are read, words of which `least_hits` say it outright, and concepts that must, may and must not be there. hard: whether its dimension must pass; by default those of HARD do."""

    dimension: str
    fields: tuple[str, ...]
    keywords: tuple[str, ...]
    required: tuple[str, ...] = ()
    supporting: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    least_hits: int = 1
    hard: bool | None = None


#: Dimensions that must pass, the least confidence of content, and what supporting concepts count for.
HARD, LEAST_CONFIDENCE, SUPPORTING_SHARE = ("space", "content", "subject", "event"), 0.60, 0.15

#: Concepts and the names that they go by.
CONCEPTS = {
    "living_room": "客厅 起居室 客餐厅 沙发区 电视背景墙",
    "dining_room": "餐厅 用餐区 客餐厅 餐桌 餐椅",
    "kitchen": "厨房 灶台 油烟机 厨房水槽 橱柜操作台",
    "bathroom": "卫生间 浴室 洗手间 马桶 坐便器 淋浴区 浴缸 浴室柜",
    "bedroom": "卧室 睡眠区 床头 衣柜与床",
    "balcony": "阳台 露台 晾晒区",
    "hallway": "过道 走廊 楼道 楼梯间",
    "room_door": "房门 入户门 室内门 木门 门套 门框",
    "residential_entrance": "小区门头 小区入口 小区名称 小区外立面 住宅区入口",
    "quotation_document": "手写报价 报价单 预算表 工程预算 价格表 手写金额",
    "schedule_document": "行程安排 日程 排期 时间表 行程表",
    "positive_review": "业主好评 业主评价 感谢 锦旗 好评截图 聊天好评",
    "selfie": "自拍 自拍照 人物近照 手持手机自拍 镜面自拍",
    "commencement_ceremony": "开工大吉 开工仪式 开工庆祝 开工活动 开工锤 红色横幅",
    "demolition": "拆除 打拆 凿除 墙体拆除 瓷砖拆除 墙地砖铲除 建筑垃圾",
    "water_electric": "水电 电线 电缆 线管 电管 水管 给排水管 开槽布管 强弱电箱",
    "woodwork": "木工 木作 木饰面 木板 板材 石膏板 龙骨 吊顶 柜体 封板 护墙板",
    "masonry": "泥工 瓦工 泥瓦 砌砖 贴砖 瓷砖铺贴 防水层 找平层",
    "painting": "油漆 墙漆 乳胶漆 腻子 涂刷 喷漆 墙面漆",
    "materials": "材料进场 建材 板材堆放 瓷砖箱 水泥袋 电线卷 管材 材料验收",
    "main_installation": "主材安装 洁具安装 灯具安装 木门安装 地板安装 橱柜安装 五金安装",
    "cabinet_installation": "打柜子 柜体施工 定制柜 柜子安装 柜体安装 现场木作柜",
    "inspection": "验收 检查施工 测量检查 检测仪 验收记录 现场核验",
    "completed_state": "完工 完成 已完成 已安装 已铺设 已封板 已成型 竣工 收尾",
    "pre_renovation": "装修前 改造前 原始状态 原始房屋 未装修 待改造",
    "old_house": "老房 旧房 老旧住宅 老旧室内 陈旧房屋 陈旧室内 老化痕迹 老房改造",
    "new_house": "新房 新房毛坯 毛坯新房 新建住宅",
    "completed_case": "完工案例 竣工实景 装修完成 改造完成 成品空间",
    "in_progress": "施工中 正在施工 正在拆除 拆除中 未完成 尚未 未收尾 进行中 管线外露 电线外露",
}

#: The fields that rules of a kind read.
ROOM, ROOM_THINGS = ("space", "scene", "subjects"), ("space", "scene", "subjects", "objects")
PAPER, PERSON = ("content_type", "scene", "subjects", "objects", "ocr_text"), ("content_type", "scene", "subjects", "objects")
WORK = ("scene", "condition", "subjects", "objects", "features")


def _words(names: str) -> tuple[str, ...]:
    return tuple(names.split())


#: Tags and their rules.
TAG_RULES = {
    "客厅": TagRule("space", ROOM, _words("客厅 起居室 客餐厅"), ("living_room",)),
    "餐厅": TagRule("space", ROOM, _words("餐厅 用餐区 客餐厅"), ("dining_room",)),
    "客餐厅": TagRule("space", ROOM, _words("客餐厅 客厅餐厅一体 客厅与餐厅"), ("living_room", "dining_room")),
    "厨房": TagRule("space", ROOM_THINGS, _words("厨房 橱柜 灶台 油烟机"), ("kitchen",)),
    "卫生间": TagRule("space", ROOM_THINGS, _words("卫生间 浴室 洗手间 马桶 坐便器 淋浴区 浴缸"), ("bathroom",)),
    "卧室": TagRule("space", ROOM, _words("卧室 睡眠区"), ("bedroom",)),
    "阳台": TagRule("space", ROOM, _words("阳台 露台"), ("balcony",)),
    "老房子过道": TagRule("space", ROOM, _words("过道 走廊 楼道 楼梯"), ("old_house", "hallway")),
    "老房子房门": TagRule("subject", ("scene", "subjects", "objects"), _words("房门 入户门 木门 门框"), ("room_door",)),
    "小区门头照": TagRule("subject", ("scene", "subjects", "objects", "ocr_text"), _words("小区门头 小区入口 小区名称 建筑外观 小区外立面"), ("residential_entrance",)),
    "手写报价": TagRule("content", PAPER, _words("手写报价 报价单 预算表 工程预算 价格表"), ("quotation_document",)),
    "行程安排": TagRule("content", PAPER, _words("行程安排 日程 排期 时间表"), ("schedule_document",)),
    "业主好评": TagRule("content", PAPER, _words("业主好评 业主评价 感谢 锦旗"), ("positive_review",)),
    "自拍照": TagRule("content", PERSON, _words("自拍 自拍照 人物近照"), ("selfie",)),
    "开工大吉": TagRule("event", ("scene", "condition", "subjects", "objects", "ocr_text"), _words("开工大吉 开工仪式 开工庆祝 开工活动"), ("commencement_ceremony",)),
    "拆除": TagRule("stage", WORK, _words("拆除 打拆 凿除 墙体拆除 瓷砖拆除"), ("demolition",)),
    "拆除完工": TagRule("stage", WORK, _words("拆除完成 拆除完工 打拆完成 打拆完工"), ("demolition",), ("completed_state",)),
    "水电完工": TagRule("stage", WORK, _words("水电完工 水电完成 水电施工完成"), ("water_electric",), ("completed_state",)),
    "水电验收": TagRule("stage", WORK, _words("水电验收 验收水电"), ("water_electric", "inspection")),
    "木工": TagRule("stage", WORK, _words("木工施工 木作施工 木工"), ("woodwork",), (), ("cabinet_installation",)),
    "木工完工": TagRule("stage", WORK, _words("木工完工 木工完成 木作完工"), ("woodwork",), ("completed_state",), ("cabinet_installation",)),
    "木工验收": TagRule("stage", WORK, _words("木工验收 木作验收"), ("woodwork", "inspection")),
    "泥工验收": TagRule("stage", WORK, _words("泥工验收 瓦工验收 泥瓦验收"), ("masonry", "inspection")),
    "油漆完工": TagRule("stage", WORK, _words("油漆完工 涂刷完成 墙漆完成"), ("painting",), ("completed_state",)),
    "材料验收": TagRule("stage", (*WORK, "ocr_text"), _words("材料验收 材料进场 建材验收"), ("materials",), ("inspection",)),
    "主材安装验收": TagRule("stage", WORK, _words("主材安装 安装验收 主材验收"), ("main_installation",), ("inspection",)),
    "打柜子": TagRule("stage", WORK, _words("打柜子 柜体施工 定制柜安装 柜子安装"), ("cabinet_installation", "in_progress")),
    "装修前": TagRule("stage", WORK, _words("装修前 改造前 原始状态"), ("pre_renovation",)),
    "老房子装修前": TagRule("stage", WORK, _words("老房装修前 旧房装修前 老房改造前 旧房改造前 原始老房"), ("old_house", "pre_renovation")),
    "新房装修前": TagRule("stage", WORK, _words("新房装修前 新房原始状态 新房毛坯"), ("new_house", "pre_renovation")),
    "完工案例": TagRule("stage", WORK, _words("完工 竣工 装修完成 改造完成"), ("completed_case",)),
}
