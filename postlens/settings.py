"""Names, weights and thresholds that results depend on."""

# Task name -> column that holds its target.
TASK_COLUMNS = {
    "ctr": "ctr",
    "like_rate": "like_rate",
    "fav_rate": "fav_rate",
    "comment_rate": "comment_rate",
    "share_rate": "share_rate",
    "follow_rate": "follow_rate",
    "interaction_rate": "interaction_rate",
    "ces_rate": "ces_rate",
    "impression": "impression_log",
    "sort_score": "sort_score2",
}

# Rate target -> counter it is made from.
RATE_COUNTERS = {
    "like_rate": "like_num",
    "fav_rate": "fav_num",
    "comment_rate": "cmt_num",
    "share_rate": "share_num",
    "follow_rate": "follow_from_discovery_num",
}

# Counter -> weight in the engagement score.
CES_WEIGHTS = {
    "like_num": 1,
    "fav_num": 1,
    "cmt_num": 4,
    "share_num": 4,
    "follow_from_discovery_num": 4,
}

# Pairs tried in order when a click rate has to be derived.
CTR_PAIRS = [("imp_num", "click_num"), ("impression", "click"), ("imp", "clk")]

IMPRESSION_CEILING = 10_000_000

# Loss weights; a task not listed weighs 1.
TASK_WEIGHTS = {"ctr": 3.0, "sort_score": 3.0, "interaction_rate": 2.0, "ces_rate": 2.0}

TAG_COLUMNS = ["intention_lv1", "intention_lv2is_mcn", "taxonomy1", "taxonomy2", "taxonomy3"]
DEFAULT_TAG_WORDS = ["其他", "None", "null", "nan", "", "unknown", "未知", "暂无"]

# Content cutting: a text above CONTENT_LIMIT characters is cut into pieces of CHUNK_SIZE.
CONTENT_LIMIT, CHUNK_SIZE = 200, 52

# Token aggregation: confidence floor.
OCR_CONFIDENCE = 0.3

# Vector groups, in output order.
VECTOR_PREFIXES = {
    "cover_image": "cover_image_feat_",
    "inner_image": "inner_image_feat_",
    "title": "title_feat_",
    "content": "content_feat_",
    "tag": "tag_feat_",
    "cover_ocr": "cover_ocr_feat_",
    "inner_ocr": "inner_ocr_feat_",
}
LEGACY_PREFIXES = {"image_feat_": "cover_image_feat_", "text_feat_": "title_feat_"}
DEPRECATED_PREFIXES = ["cover_image_embedding_", "inner_images_embedding_", "title_embedding_", "content_embedding_"]

# Column roles for multi-task preparation.
ROLE_EXCLUDE = [
    "ctr", "like_rate", "fav_rate", "comment_rate", "share_rate", "follow_rate",
    "interaction_rate", "ces_rate", "impression_log", "sort_score2",
    "total_interactions", "note_id", "user_id",
]
ROLE_VECTOR = [
    "cover_image_feat_", "inner_image_feat_", "title_feat_", "content_feat_", "tag_feat_",
    "text_feat_", "image_feat_", "cover_ocr_feat_", "inner_ocr_feat_",
]
ROLE_SPARSE = ["taxonomy1", "taxonomy2", "taxonomy3", "intention_lv1", "note_marketing_integrated_level"]
ROLE_DENSE = ["title_length", "content_length", "num_images"]
ROLE_RENAMES = {"type": "note_type", "intention_lv2is_mcn": "intention_lv2"}

# Feature presets.
_BASE_SPARSE = ["nickname", "user_id", "title_clean", "ocr_text", "type"]
FEATURE_PRESETS = {
    "basic": {"sparse": _BASE_SPARSE, "dense": ["title_length"], "clip_image": False, "clip_text": False},
    "clip_only": {"sparse": [], "dense": [], "clip_image": True, "clip_text": True},
    "no_image": {"sparse": _BASE_SPARSE, "dense": ["title_length"], "clip_image": False, "clip_text": True},
    "no_text": {"sparse": _BASE_SPARSE, "dense": ["title_length"], "clip_image": True, "clip_text": False},
    "default": {"sparse": _BASE_SPARSE, "dense": ["title_length"], "clip_image": True, "clip_text": True},
    "all": {
        "sparse": _BASE_SPARSE + ["intention_lv1", "taxonomy1", "taxonomy2"],
        "dense": ["title_length"], "clip_image": True, "clip_text": True,
    },
}
PRESET_NOTES = {
    "basic": "attributes without vectors",
    "clip_only": "vectors only",
    "no_image": "attributes and text vectors",
    "no_text": "attributes and image vectors",
    "default": "attributes and vectors",
    "all": "attributes, tags and vectors",
    "custom": "caller's own lists",
}
DETECT_SPARSE = [
    "nickname", "title_clean", "type", "ocr_text", "intention_lv1", "intention_lv2",
    "taxonomy1", "taxonomy2", "taxonomy3",
]
DETECT_DENSE = ["title_length", "content_length", "tag_count"]

# Metric -> (good above/below, warning above/below); a negative direction means lower is better.
METRIC_GRADES = {
    "silhouette": (1, 0.5, 0.3),
    "similarity_gap": (1, 0.3, 0.1),
    "zero_variance_pct": (-1, 10.0, 30.0),
    "pca_reduction": (1, 0.5, 0.2),
    "auc": (1, 0.7, 0.6),
    "retention_pct": (1, 50.0, 20.0),
}

CLUSTER_COUNTS = [10, 20, 30, 50]
PROFILE_PERCENTILES = [0.01, 0.05, 0.25, 0.75, 0.95, 0.99]
