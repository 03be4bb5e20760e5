"""Parameters and word lists of the lecture analysis.

Fixed values: thresholds and word lists that results depend on, in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

FILLER_CUES = ("嗯", "啊", "呃", "这个", "那个", "就是", "那么")
TEACHER_CUES = (
    "我们", "下面", "今天", "讲", "来看", "举个例子", "同学们", "回顾", "总结", "总之", "注意", "定义", "公式", "原理",
    "人工智能", "历史", "先", "然后", "接下来", "这个问题", *FILLER_CUES, "大家", "注意看", "来看一下",
)
STUDENT_CUES = ("老师", "请问", "我想问", "是不是", "对吗", "为什么", "怎么", "听不清", "没听懂", "可以再说", "啥意思")
QUESTION_CUES = ("请回答", "你来", "这位同学", "什么问题", "怎么理解", "请你", "谁来说")
ANSWER_CUES = ("我认为", "我觉得", "我的答案是", "我来回答", "我理解是", "我认为是")
KEYWORD_BLACKLIST = (
    "这个", "那个", "就是", "然后", "所以", "我们", "你们", "他们", "可以", "应该", "需要", "东西", "问题", "内容", "方面", "方法",
    "這個", "那個", "我們", "你們", "他們", "應該", "東西", "問題", "內容", "一個",
)
STOP_WORDS = (
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着",
    "没有", "看", "好", "自己", "这", "那", "里", "而", "啊", "吧", "呢", "嗯", "啦", "对", "所以", "因为", "如果", "但是", "然后", "然而",
    "因此", "这个", "那个", "我们", "他们", "它们", "什么", "怎么", "哪里", "哪个", "这里", "那里", "可以", "应该", "需要", "一些",
    "很多", "非常", "比较", "可能", "已经", "通过", "进行", "使用", "方面", "方法", "问题", "情况", "内容", "过程", "就是", "其实",
    "现在", "时候", "地方", "东西", "感觉", "知道", "觉得", "认为",
)
REPLACEMENTS = {"亚丽师多德": "亚里士多德", "人工质能": "人工智能", "图林": "图灵", "低谱": "低谷", "运遇": "机遇"}
TERMS = ("人工智能", "机器学习", "深度学习", "神经网络", "图灵", "图灵测试", "亚里士多德", "算法", "数据集", "低谷", "模型", "训练", "推理")
TEACHER, STUDENT, UNKNOWN = "教师", "学生", "未知"
TEACHER_NAMES = ("teacher", "lecturer", "t", "教师", "老师", "讲师")
STUDENT_NAMES = ("student", "s", "学生", "学员", "同学")


@dataclass(frozen=True)
class Config:
    no_speech: float = 0.80
    short_text: int = 3
    low_confidence: float = 0.60
    min_text: int = 5
    presence_motion: float = 0.02
    slide_change: float = 0.70
    timeline_text: int = 60
    preview_text: int = 120
    window: int = 3
    boundary: float = 0.35
    merge_within: float = 22.5
    min_knowledge: float = 45.0
    max_knowledge: float = 1200.0
    keywords: int = 5
    title_words: int = 2
    min_doc_freq: int = 2
    resolution: float = 1.0
    absent_ratio: float = 0.70
    silent_ratio: float = 0.80
    silence_s: float = 15.0
    min_interference: float = 5.0
    rule_a_s: float = 10.0
    qa_s: float = 600.0
    qa_text: int = 3
    min_segment: float = 20.0
    padding: float = 5.0
    model_gap: float = 1.5
    teacher_prob: float = 0.45
    acoustic_weight: float = 0.62
    text_weight: float = 0.38
    center_quantile: float = 0.35
    bias: float = 0.30
    borderline: tuple[float, float] = (0.28, 0.60)
    proto_quantile: float = 0.65
    shortest_voice: float = 0.4
    smooth_window: int = 3
    smooth_duration: float = 4.0
    similarity: float = 0.82
    margin: float = 0.03
    post_min_gap: float = 30.0
    post_max_gap: float = 600.0
    positive_weight: float = 3.0
    negative_ratio: int = 3
    eps: float = 1e-6


CONFIG = Config()
