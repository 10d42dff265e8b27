"""boutline.functions"""
