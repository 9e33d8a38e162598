"""Word lists and unit tables. They are data: replace any of them with ``Lexicon.load``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

# ---- fixed values: units, words and aliases that results depend on, in their given order ----

MEASURES: dict[str, tuple[str, float]] = {
    "mg": ("weight", 0.001),
    "毫克": ("weight", 0.001),
    "g": ("weight", 1.0),
    "克": ("weight", 1.0),
    "kg": ("weight", 1000.0),
    "千克": ("weight", 1000.0),
    "公斤": ("weight", 1000.0),
    "斤": ("weight", 500.0),
    "两": ("weight", 50.0),
    "磅": ("weight", 453.592),
    "lb": ("weight", 453.592),
    "oz": ("weight", 28.3495),
    "盎司": ("weight", 28.3495),
    "ml": ("volume", 1.0),
    "mL": ("volume", 1.0),
    "毫升": ("volume", 1.0),
    "cl": ("volume", 10.0),
    "l": ("volume", 1000.0),
    "升": ("volume", 1000.0),
    "L": ("volume", 1000.0),
}
COUNT_WORDS = "连包 连杯 件装 只装 个装 片装 袋装 盒装 包装 瓶 罐 盒 袋 包 支 个 只 片 条 卷 组 入 杯 块 枚 把 捆 提 听 桶 件 双 对".split()
TITLE_COUNT_WORDS = "连包 件装 只装 个装 片装 袋装 盒装 包装 瓶 罐 盒 袋 包 支 个 只 片 条 卷 组 入 杯 块 枚 提 听 桶 件".split()
DANGLING_WORDS = "连包 件装 只装 个装 片装 袋装 盒装 包装 瓶 罐 盒 袋 包 支 只 片 条 卷 组 入 杯 块 枚 提 听 桶 件".split()
STOPWORDS = "自营 旗舰店 官方 正品 包邮 顺丰 当日达 次日达 新品 热卖 爆款 限时 特价 促销 秒杀 直降 券后 到手价 整箱 批发 囤货 家庭装 量贩装 临期 进口 国产 现货 预售 赠品 试用装".split()
SPEC_NOISE = r"第二件\d*折|买\d+送\d+|满\d+减\d+|\d+折|直降\d+|立减\d+|券后|到手价"
TITLE_PROMO = r"第二件\d*折|买\d+送\d+|满\d+减\d+|\d+折起|\d+折|立减\d+"
TITLE_MEASURES = "mg 毫克 kg 千克 公斤 g 克 斤 两 磅 lb oz 盎司 ml 毫升 cl l 升".split()
BRANDS = (
    "农夫山泉 怡宝 娃哈哈 百岁山 康师傅 统一 今麦郎 可口可乐 百事可乐 雪碧 芬达 美年达 元气森林 东鹏特饮 红牛 "
    "伊利 蒙牛 光明 特仑苏 金典 安慕希 纯甄 君乐宝 三元 金龙鱼 福临门 鲁花 多力 胡姬花 海天 李锦记 厨邦 太太乐 老干妈 "
    "三只松鼠 良品铺子 百草味 洽洽 乐事 奥利奥 达利园 好丽友 雀巢 星巴克 麦斯威尔 立顿 维达 清风 心相印 洁柔 得宝 "
    "蓝月亮 立白 雕牌 汰渍 碧浪 奥妙 舒肤佳 力士 海飞丝 潘婷 飘柔 清扬 沙宣 云南白药 高露洁 佳洁士 黑人 "
    "五常 金沙河 香满园 双汇 金锣 雨润 得利斯 安佳 总统 president 卡夫 费列罗 德芙 士力架"
).split()
CATEGORY_HINTS: dict[str, list[str]] = {
    "饮用水": "饮用水 天然水 矿泉水 纯净水".split(),
    "碳酸饮料": "可乐 汽水 雪碧 芬达 苏打".split(),
    "牛奶": "牛奶 纯牛奶 酸奶 乳饮料 早餐奶".split(),
    "食用油": "食用油 调和油 花生油 玉米油 菜籽油 橄榄油 葵花籽油".split(),
    "大米": "大米 稻花香 珍珠米 丝苗米 香米".split(),
    "面条": "红烧牛肉面 香辣牛肉面 牛肉面 面条 挂面 方便面 拉面 泡面 米线".split(),
    "调味品": "酱油 生抽 老抽 米醋 陈醋 蚝油 料酒 味精 鸡精".split(),
    "零食": "坚果 薯片 饼干 巧克力 糖果 果冻 辣条 果干".split(),
    "纸品": "抽纸 卷纸 纸巾 手帕纸 湿巾".split(),
    "洗涤": "洗衣液 洗洁精 洗衣粉 柔顺剂 消毒液".split(),
    "个护": "洗发水 沐浴露 牙膏 牙刷 香皂 洗手液".split(),
    "肉类": "猪肉 牛肉 鸡肉 排骨 香肠 火腿".split(),
    "咖啡茶": "咖啡 红茶 绿茶 茶包 速溶".split(),
}
VARIANTS: dict[str, list[str]] = {
    "口味": "红烧 香辣 麻辣 老坛酸菜 酸菜 番茄 咖喱 香菇 排骨 海鲜 五香 孜然 烧烤 原味 清淡".split(),
    "甜味": "巧克力 草莓 香草 抹茶 芒果 蓝莓 椰子 焦糖 蜂蜜".split(),
    "脂肪": "全脂 低脂 脱脂 半脱脂".split(),
    "糖分": "无糖 零糖 低糖 含糖 代糖".split(),
    "咖啡因": "低因 脱因 无咖啡因".split(),
    "工艺": "有机 非转基因 鲜榨 浓缩 冷萃 现磨 速溶".split(),
    "形态": "袋装 罐装 瓶装 盒装 桶装 散装".split(),
    "色系": "纯白 薰衣草 芦荟 柠檬 海洋 樱花".split(),
}
NEUTRAL_VARIANTS = ["形态"]
PRODUCT_LINES = (
    "特仑苏 金典 安慕希 纯甄 优酸乳 每益添 QQ星 臻浓 未来星 黄金比例 金标 味极鲜 一级压榨 稻花香 长粒香 "
    "无糖茶π 茶π 尖叫 维他命水 东方树叶 无限 每日坚果 夹心 威化 醇品 金牌 丝滑拿铁 "
    "蓝色经典 超韧 深层洁净 亮白增艳 自然阳光 王中王 润口香甜"
).split()
FIELD_ALIASES: dict[str, list[str]] = {
    "sku_id": "sku_id sku 商品id 商品ID 商品编码 货号 item_id".split(),
    "title": "title 商品标题 商品名称 品名 名称 product_name".split(),
    "price": "price 售价 价格 现价 成交价 到手价 sale_price".split(),
    "origin_price": "origin_price 原价 划线价 标价 list_price".split(),
    "brand": "brand 品牌 品牌名".split(),
    "category": "category 品类 类目 分类".split(),
    "barcode": "barcode 条码 国际条码 条形码 ean upc".split(),
    "spec_text": "spec spec_text 规格 包装规格 净含量".split(),
    "city": "city 城市 所在城市".split(),
    "store": "store 门店 门店名称 店铺".split(),
    "url": "url 链接 商品链接 商品url".split(),
    "image_url": "image_url 图片 图片链接 主图 商品图片 image".split(),
    "collected_at": "collected_at 采集时间 抓取时间 更新时间".split(),
}
NULL_WORDS = ["", "nan", "none", "null", "na", "n/a", "-", "—"]
NULL_PRICES = ["", "nan", "none", "-", "—"]

# ---- end of fixed values ----

REQUIRED = ("sku_id", "title")


def longest_first(words: list[str]) -> list[str]:
    """Longer words first; words of one length keep their order."""
    return sorted(words, key=len, reverse=True)


@dataclass
class Lexicon:
    measures: dict[str, tuple[str, float]] = field(default_factory=lambda: dict(MEASURES))
    count_words: list[str] = field(default_factory=lambda: list(COUNT_WORDS))
    stopwords: list[str] = field(default_factory=lambda: list(STOPWORDS))
    brands: list[str] = field(default_factory=lambda: list(BRANDS))
    category_hints: dict[str, list[str]] = field(default_factory=lambda: dict(CATEGORY_HINTS))
    variants: dict[str, list[str]] = field(default_factory=lambda: dict(VARIANTS))
    neutral_variants: list[str] = field(default_factory=lambda: list(NEUTRAL_VARIANTS))
    product_lines: list[str] = field(default_factory=lambda: list(PRODUCT_LINES))
    aliases: dict[str, list[str]] = field(default_factory=lambda: dict(FIELD_ALIASES))

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """The defaults with the lists of a JSON or YAML file in their place."""
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            given = json.loads(text)
        else:
            import yaml

            given = yaml.safe_load(text)
        known = {f.name for f in fields(cls)}
        if odd := set(given) - known:
            raise ValueError(f"unknown lists: {sorted(odd)}; known are {sorted(known)}")
        out = cls(**given)
        out.measures = {unit: (str(kind), float(factor)) for unit, (kind, factor) in out.measures.items()}
        return out

    def field_of(self, header: str) -> str | None:
        """The standard field that a column header names."""
        key = str(header).strip().lower().replace(" ", "")
        return next((f for f, names in self.aliases.items() if key in {n.lower().replace(" ", "") for n in names}), None)


DEFAULT = Lexicon()
