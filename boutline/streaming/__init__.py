"""boutline.streaming"""
