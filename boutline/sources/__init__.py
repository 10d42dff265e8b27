"""boutline.sources"""
